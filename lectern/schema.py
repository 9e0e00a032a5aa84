"""Data model of the event corpus (column names and column roles).

Fixed values: these names and orders must equal the reference's, because
they decide which columns exist, which are cleaned, the order in which
texts are joined, and which metadata travels with each chunk.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (reference data model) ------------------------------------
# Input record fields kept, in this order, and their output names.
EVENT_COLUMNS = [
    ("uid", "id"),
    ("title_fr", "titre"),
    ("description_fr", "description"),
    ("longdescription_fr", "description_complete"),
    ("keywords_fr", "mots_cles"),
    ("firstdate_begin", "date_debut"),
    ("lastdate_end", "date_fin"),
    ("location_name", "lieu"),
    ("location_address", "adresse"),
    ("location_postalcode", "code_postal"),
    ("location_city", "ville"),
    ("location_department", "departement"),
    ("location_coordinates", "coordonnees_gps"),
    ("canonicalurl", "url"),
    ("updatedat", "date_mise_a_jour"),
    ("conditions_fr", "conditions"),
]
# Field used only by the date/region predicate.
REGION_FIELD = "location_region"
DATE_FIELD = "firstdate_begin"
# Columns that are cleaned (null -> '', HTML -> text, whitelist, spaces).
TEXT_COLUMNS = ["titre", "description", "description_complete", "mots_cles",
                "lieu", "adresse", "code_postal", "ville", "departement",
                "conditions"]
# Columns joined, in this order, into the combined text.
JOINED_COLUMNS = ["titre", "description", "description_complete",
                  "mots_cles", "lieu", "ville"]
JOIN_SEPARATOR = " . "
KEYWORD_COLUMN = "mots_cles"
KEYWORD_SEPARATOR = ", "
COMBINED_TEXT = "texte_complet"
# Metadata kept with every chunk (existing ones only), then chunk_id, source.
METADATA_COLUMNS = ["id", "titre", "date_debut", "date_fin", "ville",
                    "code_postal", "adresse", "lieu", "mots_cles", "url"]
DEFAULT_SOURCE = "openagenda"
DEFAULT_REGION = "Occitanie"
DEFAULT_MIN_CHARS = 200
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 100
SPLIT_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
PAGE_SIZE = 100
EMBED_BATCH_SIZE = 50
K_SERVICE = 3      # answer service and search tool
K_EVALUATION = 5   # chatbot / evaluation retriever
MIN_FAITHFULNESS = 0.8
MIN_CONTEXT_PRECISION = 0.5
# ---------------------------------------------------------------------------

RENAMES = dict(EVENT_COLUMNS)

# Every field is read as STRING: a JSON list or number read into a STRING
# field keeps its raw JSON text, so nothing is lost and keyword lists and
# plain keyword strings can share one column.
RECORD_SCHEMA = T.StructType(
    [T.StructField(src, T.StringType()) for src, _ in EVENT_COLUMNS]
    + [T.StructField(REGION_FIELD, T.StringType())])

PAGE_SCHEMA = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("results", T.ArrayType(RECORD_SCHEMA)),
])
