"""Column contracts of the tables that operators take and return, as DDL."""

FILES = "path string, lang string, size bigint, hash string, text string, pos int"
SYMBOLS = (
    "id string, kind string, name string, path string, start_line int, end_line int, signature string, docstring string,"
    " calls array<string>, imports array<string>, ord int"
)
IMPORTS = "src string, dep string, is_internal boolean, ord bigint"
SIGNALS = "type string, name string, evidence array<string>"
SNIPPETS = "text string, cite string, score double, path string, lang string, symbol string, kind string, pos bigint"
NODES = "id string, kind string, label string, meta map<string,string>"
EDGES = "src string, dst string, edge_type string, ord bigint"
VECTORS = "cite string, embedding array<float>"
MANIFEST = "path string, hash string"
PAGEMAP = "page string, source_files array<string>, source_symbols array<string>, file_hashes map<string,string>, human_edited boolean"
SUMMARIES = (
    "path string, responsibility string, business_relevance string, confidence string, source_hash string, what_it_does string,"
    " key_symbols array<string>, citations array<string>, interfaces array<string>, dependencies array<string>,"
    " data_touched array<string>, key_behaviors array<string>, schema_version int"
)
PAGES = (
    "rel_path string, title string, type string, audience string, summary string, sections array<struct<heading:string,body:string>>,"
    " sources array<string>, related array<string>, tags array<string>, confidence string"
)
LOG = "ts timestamp, event string, detail string"
