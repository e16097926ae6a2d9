"""Deterministic views that shape general tables into the engine's tables, so that every operator runs on real volume.

`SQL` holds the same views as common table expressions for the oracle; the two are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_id

#: Symbols of one file.
PER_FILE = 20
LANGUAGES = ("rust", "go", "typescript", "java")
EXTENSIONS = ("rs", "go", "ts", "java")
KINDS = ("function", "method", "field", "const", "local")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _path(f):
    return F.concat(F.when(f % 3 == 0, "Src").otherwise("src"), F.lit("/pkg"), (f % 10).cast("string"), F.lit("/file"), f.cast("string"), F.lit("."), _pick(EXTENSIONS, f % 4))


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """One symbol a part: spellings in four casings of the two words of its name, nested ranges in files of PER_FILE."""
    key, f = F.col("p_partkey"), F.floor(F.col("p_partkey") / PER_FILE)
    i, w = key % PER_FILE, F.split("p_name", " ")
    one, two = w[0], w[1]
    spelling = F.when(key % 4 == 0, F.concat(one, F.initcap(two))).when(key % 4 == 1, F.concat(F.initcap(one), F.initcap(two))).when(key % 4 == 2, F.concat(one, F.lit("_"), two)).otherwise(F.concat(F.upper(one), F.lit("_"), F.upper(two)))
    kind = F.when(i == 0, "module").when(i % 5 == 0, "class").otherwise(_pick(KINDS, key % 5))
    return read(spark, folder, "part").select(
        F.concat(F.lit("sym-"), key.cast("string")).alias("symbol_id"),
        _path(f).alias("relative_path"),
        _pick(LANGUAGES, f % 4).alias("language"),
        kind.alias("kind"),
        spelling.alias("spelling"),
        F.when(i == 0, F.lit(None)).when(key % 11 == 0, F.lit(None)).otherwise(F.regexp_replace("p_brand", "#", "")).alias("container"),
        F.concat(kind, F.lit(" "), spelling, F.lit("("), F.lower("p_type"), F.lit(")")).alias("signature"),
        (i * 100 + 10).cast("long").alias("start_byte"),
        (i * 100 + 10 + F.length(spelling)).cast("long").alias("end_byte"),
        (i * 100).cast("long").alias("syntax_start_byte"),
        F.when(i == 0, 2000).when(i % 5 == 0, i * 100 + 500).otherwise(i * 100 + 90).cast("long").alias("syntax_end_byte"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the symbols, and one without symbols for each supplier."""
    f = F.floor(F.col("p_partkey") / PER_FILE)
    code = read(spark, folder, "part").filter(F.col("p_partkey") % PER_FILE == 0).select(
        _path(f).alias("relative_path"),
        _pick(LANGUAGES, f % 4).alias("language"),
        (f * 7 + 2000).cast("long").alias("byte_length"),
        F.when(f % 13 == 0, "failed").when(f % 7 == 0, "partial").otherwise("complete").alias("parse_status"),
    )
    key = F.col("s_suppkey")
    other = read(spark, folder, "supplier").select(
        F.concat(F.lit("docs/note"), key.cast("string"), F.lit(".dart")).alias("relative_path"),
        F.lit("dart").alias("language"),
        (key + 10).cast("long").alias("byte_length"),
        F.lit("complete").alias("parse_status"),
    )
    return code.unionByName(other).withColumn("content_hash", F.sha2(F.concat("relative_path", F.lit(":"), F.col("byte_length").cast("string")), 256))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between symbols as numbers, one for each line: source its part, target by order and supplier."""
    parts = read(spark, folder, "part").agg(F.count(F.lit(1)).alias("parts"))
    line = read(spark, folder, "lineitem").join(F.broadcast(parts))  # one row
    target = (F.col("l_orderkey") + 7 * F.col("l_suppkey")) % F.col("parts")
    return line.select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("relationship"),
        F.col("l_partkey").alias("source_key"),
        target.alias("target_key"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("resolution"),
        (F.col("l_quantity") * 10).cast("long").alias("source_start_byte"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


def _symbol(key: str) -> F.Column:
    return F.concat(F.lit("sym-"), F.col(key).cast("string"))


#: The ends of an edge, of a line's numbers: their text, and the number that it stands for.
LINE_ENDS = {
    "source_symbol_id": lambda: (_symbol("source_key"), "source_key"),
    "target_symbol_id": lambda: (_symbol("target_key"), "target_key"),
    "target_path": lambda: (_path(F.floor(F.col("target_key") / PER_FILE)), "target_key"),
}


def named(lines: DataFrame) -> DataFrame:
    """The edges of lines, told apart as numbers, and named after that: they hardly repeat, so all of them are held and exchanged."""
    rows = lines.distinct()
    rows = rows.withColumns({"relationship": _pick(("calls", "references", "imports"), F.col("relationship")), "resolution": _pick(("candidate", "lexically_resolved"), F.col("resolution"))})
    return rows.select(
        content_id(*(F.col(c) for c in ("relationship", "source_key", "target_key", "resolution", "source_start_byte", "line"))).alias("edge_id"),
        "relationship",
        _symbol("source_key").alias("source_symbol_id"),
        _path(F.floor(F.col("source_key") / PER_FILE)).alias("source_path"),
        _symbol("target_key").alias("target_symbol_id"),
        _path(F.floor(F.col("target_key") / PER_FILE)).alias("target_path"),
        "resolution",
        "source_start_byte",
        "line",
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between symbols, one for each distinct line."""
    return named(lines(spark, folder))


def scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two scans of the documents as files: some are gone in the second, some new, some changed."""
    docs, key = read(spark, folder, "documents"), F.col("doc_id")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), key.cast("string"), F.lit(".txt")))
    hashed = F.sha2(F.coalesce("text", F.lit("")), 256)
    base = docs.select(key, path.alias("relative_path"), F.col("lang").alias("language"), hashed.alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("byte_length"))
    first = base.filter(key % 10 != 0).select("relative_path", "language", F.col("h").alias("content_hash"), F.lit("v1").alias("analysis_key"), "byte_length")
    second = base.filter(key % 10 != 1).select("relative_path", "language", F.when(key % 7 == 0, F.sha2(F.concat("h", F.lit("+")), 256)).otherwise(F.col("h")).alias("content_hash"), F.when(key % 13 == 0, "v2").otherwise("v1").alias("analysis_key"), "byte_length")
    return first, second


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions of notes: one for each turn of a conversation."""
    return read(spark, folder, "conversations").select(
        F.concat(F.lit("note-"), F.col("conv_id").cast("string")).alias("id"),
        F.col("turn").cast("long").alias("revision"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.col("role").alias("scope"),
        (F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("updated_at"),
    )


def note_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Files that notes rest on, some with a hash that no longer holds."""
    code = files(spark, folder).filter("language <> 'dart'").withColumn("n", F.regexp_extract("relative_path", r"file(\d+)", 1).cast("long"))
    return code.select(
        F.concat(F.lit("note-"), (F.col("n") % 50).cast("string")).alias("memory_id"),
        "relative_path",
        F.when(F.col("n") % 9 == 0, F.lit("0" * 64)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("sym-"), (F.col("n") * PER_FILE).cast("string"))).alias("symbol_id"),
    )


def hints(spark: SparkSession, folder: str) -> DataFrame:
    """Change hints: one for each event."""
    return read(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("src/user"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", ".tmp").otherwise(".rs")).alias("path"), F.col("event_type").alias("kind"))


def _path_sql(f: str) -> str:
    return f"CASE WHEN {f} % 3 = 0 THEN 'Src' ELSE 'src' END || '/pkg' || ({f} % 10)::VARCHAR || '/file' || ({f})::VARCHAR || '.' || (['rs', 'go', 'ts', 'java'])[{f} % 4 + 1]"


_INIT = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_LANGUAGE = "(['rust', 'go', 'typescript', 'java'])[f % 4 + 1]"
SQL = {
    "symbols": f"""symbols AS (SELECT symbol_id, relative_path, language, kind, spelling, container, kind || ' ' || spelling || '(' || lower(p_type) || ')' AS signature,
  i * 100 + 10 AS start_byte, i * 100 + 10 + length(spelling) AS end_byte, i * 100 AS syntax_start_byte,
  CASE WHEN i = 0 THEN 2000 WHEN i % 5 = 0 THEN i * 100 + 500 ELSE i * 100 + 90 END AS syntax_end_byte
FROM (SELECT 'sym-' || p_partkey::VARCHAR AS symbol_id, {_path_sql("f")} AS relative_path, {_LANGUAGE} AS language, p_type, i,
    CASE WHEN i = 0 THEN 'module' WHEN i % 5 = 0 THEN 'class' ELSE (['function', 'method', 'field', 'const', 'local'])[p_partkey % 5 + 1] END AS kind,
    CASE p_partkey % 4 WHEN 0 THEN a || {_INIT.format("b")} WHEN 1 THEN {_INIT.format("a")} || {_INIT.format("b")} WHEN 2 THEN a || '_' || b ELSE upper(a) || '_' || upper(b) END AS spelling,
    CASE WHEN i = 0 OR p_partkey % 11 = 0 THEN NULL ELSE replace(p_brand, '#', '') END AS container
  FROM (SELECT *, p_partkey // 20 AS f, p_partkey % 20 AS i, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) p) s)""",
    "files": f"""files AS (SELECT *, sha256(relative_path || ':' || byte_length::VARCHAR) AS content_hash FROM (
  SELECT {_path_sql("f")} AS relative_path, {_LANGUAGE} AS language, f * 7 + 2000 AS byte_length,
    CASE WHEN f % 13 = 0 THEN 'failed' WHEN f % 7 = 0 THEN 'partial' ELSE 'complete' END AS parse_status
  FROM (SELECT p_partkey // 20 AS f FROM part WHERE p_partkey % 20 = 0) p
  UNION ALL SELECT 'docs/note' || s_suppkey::VARCHAR || '.dart', 'dart', s_suppkey + 10, 'complete' FROM supplier) x)""",
    "edges": f"""edges AS (SELECT sha256(relationship || chr(0) || source_key::VARCHAR || chr(0) || target_key::VARCHAR || chr(0) || resolution || chr(0) || source_start_byte::VARCHAR || chr(0) || line::VARCHAR || chr(0)) AS edge_id,
  relationship, 'sym-' || source_key::VARCHAR AS source_symbol_id, {_path_sql("(source_key // 20)")} AS source_path,
  'sym-' || target_key::VARCHAR AS target_symbol_id, {_path_sql("(target_key // 20)")} AS target_path, resolution, source_start_byte, line
FROM (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'references' ELSE 'imports' END AS relationship, l_partkey AS source_key,
    (l_orderkey + 7 * l_suppkey) % (SELECT count(*) FROM part) AS target_key, CASE l_linestatus WHEN 'O' THEN 'candidate' ELSE 'lexically_resolved' END AS resolution,
    CAST(l_quantity * 10 AS BIGINT) AS source_start_byte, CAST(l_linenumber AS BIGINT) AS line FROM lineitem) l)""",
    "scans": """base AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id::VARCHAR || '.txt' AS relative_path, lang AS language, sha256(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS byte_length FROM documents),
active AS (SELECT relative_path, language, h AS content_hash, 'v1' AS analysis_key, byte_length FROM base WHERE doc_id % 10 <> 0),
scanned AS (SELECT relative_path, language, CASE WHEN doc_id % 7 = 0 THEN sha256(h || '+') ELSE h END AS content_hash, CASE WHEN doc_id % 13 = 0 THEN 'v2' ELSE 'v1' END AS analysis_key, byte_length FROM base WHERE doc_id % 10 <> 1)""",
    "notes": "notes AS (SELECT 'note-' || conv_id::VARCHAR AS id, CAST(turn AS BIGINT) AS revision, coalesce(text, '') AS body, role AS scope, CAST(conv_id * 100 + turn AS BIGINT) AS updated_at FROM conversations)",
    "note_evidence": """note_evidence AS (SELECT 'note-' || (n % 50)::VARCHAR AS memory_id, relative_path, CASE WHEN n % 9 = 0 THEN repeat('0', 64) ELSE content_hash END AS content_hash,
  CASE WHEN n % 2 = 0 THEN 'sym-' || (n * 20)::VARCHAR END AS symbol_id FROM (SELECT *, CAST(regexp_extract(relative_path, 'file([0-9]+)', 1) AS BIGINT) AS n FROM files WHERE language <> 'dart') f)""",
    "hints": "hints AS (SELECT event_id, ts, 'src/user' || user_id::VARCHAR || CASE WHEN event_type = 'error' THEN '.tmp' ELSE '.rs' END AS path, event_type AS kind FROM events)",
}


def sql(views: str, body: str, recursive: bool = False, more: str = "") -> str:
    """An oracle query over the named views and further expressions."""
    parts = [SQL[v] for v in views.split()] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


#: Dialects of the generated sources, by file number, with their file endings.
GENERATED = (("rust", "rs"), ("go", "go"), ("java", "java"), ("csharp", "cs"), ("dart", "dart"), ("javascript", "js"), ("jsx", "jsx"), ("typescript", "ts"), ("tsx", "tsx"))
#: A line of source by dialect: {k} is a part, {t} the part that it calls. Comments and strings hold calls that are none.
LINES = {
    "rust": 'pub fn fn_{k}(a: i32) -> i32 {{ let v = a; fn_{t}(v) }} // phantom_call({k})',
    "go": 'func Fn{k}(a int) int {{ v := "phantom_call({k})"; return Fn{t}(v) }} /* phantom_call() */',
    "java": 'class C{k} {{ int m{k}(int a) {{ int v = a; return m{t}(v); }} }} // phantom_call({k})',
    "csharp": 'class C{k} {{ int M{k}(int a) {{ var v = @"phantom_call()"; return M{t}(v); }} }}',
    "dart": "int fn{k}(int a) {{ var v = 'phantom_call()'; return fn{t}(v); }}",
    "javascript": "export function fn{k}(a) {{ const v = `phantom_call()`; return fn{t}(v); }}",
    "jsx": "export function fn{k}(a) {{ const v = /phantom_call\\(/; return fn{t}(v); }}",
    "typescript": "export function fn{k}(a: number): number {{ const v = a; return fn{t}(v); }} // phantom_call()",
    "tsx": "export function fn{k}(a: number): number {{ const v = a; return fn{t}(v); }} /* é phantom_call() */",
}


def _called(key):
    return (key * 7 + 3) % F.col("parts")


def _lines(spark: SparkSession, folder: str, language, dialects: tuple[str, ...]) -> DataFrame:
    """(f, key, line) of each part: the line of its file's dialect."""
    key = F.col("p_partkey")
    parts = read(spark, folder, "part").agg(F.count(F.lit(1)).alias("parts"))
    rows = read(spark, folder, "part").select("p_partkey").join(F.broadcast(parts))  # one row
    rows = rows.select(F.floor(key / PER_FILE).alias("f"), key.alias("key"), key.cast("string").alias("k"), _called(key).cast("string").alias("t"))
    chain = F.lit(None).cast("string")
    for d in dialects:
        pieces = LINES[d].replace("{{", "\1").replace("}}", "\2").replace("{k}", "\3k\3").replace("{t}", "\3t\3").split("\3")
        line = F.concat(*[F.col(x) if x in ("k", "t") else F.lit(x.replace("\1", "{").replace("\2", "}")) for x in pieces])
        chain = F.when(language(F.col("f")) == d, line).otherwise(chain)
    return rows.select("f", "key", chain.alias("line"))


def _gathered(lines: DataFrame, head) -> DataFrame:
    """A file's lines under its head; a file holds PER_FILE lines."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "line"))), lambda r: r["line"]), "\n")
    return lines.groupBy("f").agg(F.encode(F.concat(head, text, F.lit("\n")), "UTF-8").alias("content"))


def dialect_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, language, content): sources of all dialects, a line a part."""
    language = lambda f: _pick(tuple(d for d, _ in GENERATED), f % len(GENERATED))
    files = _gathered(_lines(spark, folder, language, tuple(d for d, _ in GENERATED)), F.lit(""))
    path = F.concat(F.lit("src/file"), F.col("f").cast("string"), F.lit("."), _pick(tuple(e for _, e in GENERATED), F.col("f") % len(GENERATED)))
    return files.select(path.alias("relative_path"), language(F.col("f")).alias("language"), "content")


def go_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, language, content): Go packages of ten directories, whose functions call across files."""
    f = F.col("f")
    head = F.concat(F.lit("package p"), (F.first(f) % 10).cast("string"), F.lit("\n"))
    files = _gathered(_lines(spark, folder, lambda _: F.lit("go"), ("go",)), head)
    return files.select(F.concat(F.lit("src/pkg"), (f % 10).cast("string"), F.lit("/file"), f.cast("string"), F.lit(".go")).alias("relative_path"), F.lit("go").alias("language"), "content")
