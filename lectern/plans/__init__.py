"""Jobs that chain the operators (build, answer, search, evaluate) and the
catalogue of registered queries over the test tables."""
