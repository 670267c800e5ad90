"""Fact tables and the fixed values of the queries."""

from __future__ import annotations

from pyspark.sql import types as T

# Results depend on them.
DAMPING, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-6, 100
IDENT_BOOST, RARE_PENALTY, UNDERSCORE_PENALTY, FOCUS_BOOST = 10.0, 0.1, 0.1, 50.0
LONG_IDENT, RARE_DEFINERS = 8, 5
MAP_TOKENS, FOCUS_TOKENS = 8192, 1024
HUBS, RANKED_SYMBOLS, DEFAULT_SYMBOLS = 15, 80, 30
CONTENT_LINES, SYMBOL_MATCHES = 40, 50
MAX_DEPTH, FRONTIER, MAX_NODES = 5, 200, 500
BM25_K1, BM25_B, RANK_WEIGHT = 1.2, 0.75, 0.5
STOPWORDS = ("the", "a", "an", "that", "which", "is", "of", "for", "to", "where", "in", "and", "or")
RELATED, SYMBOLS_PER_FILE, EXPORT_NODES, SKIP_LIST = 10, 8, 60, 100
CENSUS_SHARE = 0.3
DEGRADED_FILES, DEGRADED_COVERAGE = 10, 0.15
HUB_TIER, MID_TIER = 0.5, 0.15
CODE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
SFC_EXTENSION = "vue"
SCHEMA_VERSION = 8
TEST_FILE = r"(^|/)(__tests__|__mocks__|tests?)/|\.(test|spec)\.[cm]?[jt]sx?$"
CONTROL_CHARACTERS = r"[\x00-\x08\x0B-\x1F\x7F]"
EXCLUDED_FOLDERS = ("node_modules", ".next", ".git")
LONGEST_PATTERN, DEEPEST_FOLDER = 512, 40
#: Languages by file extension that the census counts besides the supported ones.
FOREIGN = {"py": "Python", "pyi": "Python", "go": "Go", "rs": "Rust", "java": "Java", "kt": "Kotlin", "rb": "Ruby", "php": "PHP", "cs": "C#", "swift": "Swift", "scala": "Scala", "ex": "Elixir", "exs": "Elixir", "dart": "Dart", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++", "lua": "Lua"}
#: Names of files that a content search never opens, and parts that hide a file wherever its path holds them, in either case.
SENSITIVE_FILES = (".env", ".env.*", "*.env", "*.pem", "*.key", "*.p12", "*.pfx", "*.crt", "id_rsa*", "*.p8", "*.jks", "*.keystore", "id_ed25519*", "id_ecdsa*", ".npmrc", ".netrc", ".git-credentials", ".pgpass", ".htpasswd", ".pypirc")
SENSITIVE_PARTS = ("secret", "credential", "password")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
FILES = _struct(path=_s, text=_s, size=_l, mtime=T.TimestampType())
SYMBOLS = _struct(path=_s, name=_s, kind=_s, is_export=_b, defined_in=_s, external=_b, is_reexport=_b, is_default=_b)
IMPORT_SITES = _struct(path=_s, spec=_s, names=T.ArrayType(_s), form=_s, type_only=_b)
EDGES = _struct(src=_s, dst=_s, names=T.ArrayType(_s), weight=_d)
TYPE_EDGES = _struct(src=_s, dst=_s)
CALL_EDGES = _struct(caller_file=_s, caller_line=_i, caller_name=_s, caller_decl_line=_i, callee_file=_s, callee_name=_s, callee_line=_i, callee_kind=_s, kind=_s)
