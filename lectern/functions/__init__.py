"""Native column expressions (JVM-side, whole-stage codegen friendly) and
the few small per-row Python helpers that have no built-in equivalent."""
