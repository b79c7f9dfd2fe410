"""The engine's operators as queries over the driver's tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .commits import Files
from .functions import risk, text
from .operators import dictionary, evaluate, extraction, graph, index, ops
from .operators.rerank import rerank
from .plans.bm25 import Index, top_per_query
from .plans.match import Both, Either, Near, Phrase, Without, parse
from .plans.search import Searcher, filtered
from .sources import export_json, markdown, session_jsonl
from .sources.files import glob_condition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.conversation_drawers(table(spark, sf_dir, "conversations"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_drawers(table(spark, sf_dir, "documents"))


#: Of a table's files in a session: the folder and the drawers that were written, and their index.
_STORED: dict[tuple, tuple[str, DataFrame]] = {}
_INDEXES: dict[tuple, Index] = {}


def _written(spark: SparkSession, sf_dir: str) -> tuple[tuple, str, DataFrame]:
    sc, at = spark.sparkContext, spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    key = (sc.applicationId, sf_dir, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _STORED:
        path = f"{scratch.lasting(spark)}/{uuid.uuid4().hex}"
        made = docs(spark, sf_dir)
        made.write.option("compression", "zstd").parquet(f"{path}/drawers")
        _STORED[key] = path, spark.read.schema(made.schema).parquet(f"{path}/drawers")
    return key, *_STORED[key]


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Index]:
    """The documents' drawers and their index as a store holds them: written once for a table's files in a session, then read."""
    key, path, drawers = _written(spark, sf_dir)
    if key not in _INDEXES:
        index.write_index(drawers, f"{path}/index")
        _INDEXES[key] = index.read_index(spark, f"{path}/index")
    return drawers, _INDEXES[key]


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawers alone; no index is made for them."""
    return _written(spark, sf_dir)[2]


# ---- SQL building blocks ----


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{text.WS}+', ' ', 'g'))"


def bare(c: str) -> str:
    return f"regexp_replace({c}, '^{text.WS}+|{text.WS}+$', '', 'g')"


def keep(c: str) -> str:
    body = bare(f"regexp_replace({bare(c)}, '^[^{text.WS[1:-1]}]+', '')")
    return f"(length({bare(c)}) >= 30 AND ({bare(c)} NOT LIKE '/%' OR length({body}) >= 30))"


ROLE = "CASE lower(role) WHEN 'human' THEN 'human' WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' WHEN 'model' THEN 'assistant' END"
CONV = f"""c0 AS (
  SELECT 'conversations' AS source, conv_id || ':' || turn AS source_id, {ROLE} AS role, text AS content, conv_id::VARCHAR AS thread_id,
    (1700000000 + conv_id * 86400 + turn * 60)::BIGINT AS created_at, (conv_id * 100000 + turn)::BIGINT AS rowid FROM conversations
), c1 AS (SELECT *, sha256(role || chr(31) || {norm('content')}) AS content_hash FROM c0 WHERE role IS NOT NULL AND {keep('content')}),
c2 AS (SELECT *, source || ':' || source_id || ':' || substr(content_hash, 1, 12) AS drawer_uid FROM c1),
conv AS (SELECT *, (row_number() OVER w - 1)::INTEGER AS position_in_thread, lag(drawer_uid) OVER w AS parent_uid FROM c2 WINDOW w AS (PARTITION BY thread_id ORDER BY rowid))"""
DOCS = f"""d1 AS (
  SELECT source, doc_id || ':1' AS source_id, 'wiki' AS role, text AS content, doc_id AS rowid, (1700000000 + doc_id * 60)::BIGINT AS created_at,
    sha256('wiki' || chr(31) || {norm('text')}) AS content_hash FROM documents WHERE {keep('text')}
), docs AS (SELECT *, source || ':' || source_id || ':' || substr(content_hash, 1, 12) AS drawer_uid FROM d1)"""
TOKENS = r"regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}\p{Co}\p{Mn}]+')"
POSTINGS = f"""{DOCS}, toks AS (SELECT drawer_uid AS uid, {TOKENS} AS t FROM docs),
lens AS (SELECT uid, len(t)::BIGINT AS length FROM toks), stats AS (SELECT count(*) AS n, sum(length) / count(*) AS average FROM lens),
posts AS (SELECT uid, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS term FROM toks)"""


def occurrences(p: Phrase) -> str:
    """SQL of (uid, start)."""
    tables, where = [], []
    for i, t in enumerate(p.terms):
        tables.append(f"posts p{i}" if not i else f"JOIN posts p{i} ON p{i}.uid = p0.uid AND p{i}.pos = p0.pos + {i}")
        where.append(f"starts_with(p{i}.term, '{t}')" if p.prefix and i + 1 == len(p.terms) else f"p{i}.term = '{t}'")
    return f"(SELECT p0.uid, p0.pos AS start FROM {' '.join(tables)} WHERE {' AND '.join(where + ['p0.pos = 0'] * p.initial)})"


def scored(p: Phrase, hits: str | None = None) -> str:
    """SQL of (uid, score) of a phrase."""
    return f"""(SELECT h.uid, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
      * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score
      FROM (SELECT uid, count(*) AS tf FROM {hits or occurrences(p)} GROUP BY uid) h JOIN lens ON lens.uid = h.uid, stats,
      (SELECT count(DISTINCT uid) AS df FROM {occurrences(p)}))"""


def matched(tree) -> str:
    """SQL of (uid, score) of a tree without NEAR."""
    if isinstance(tree, Phrase):
        return scored(tree)
    if isinstance(tree, Near):
        a, b = tree.phrases
        pairs = f"(SELECT x.uid, x.start AS s, y.start AS e FROM {occurrences(a)} x JOIN {occurrences(b)} y ON x.uid = y.uid AND ((y.start >= x.start AND y.start <= x.start + {len(a.terms) + tree.within}) OR (x.start >= y.start AND x.start <= y.start + {len(b.terms) + tree.within})))"
        return f"(SELECT uid, sum(score) AS score FROM (SELECT * FROM {scored(a, f'(SELECT DISTINCT uid, s FROM {pairs})')} UNION ALL SELECT * FROM {scored(b, f'(SELECT DISTINCT uid, e FROM {pairs})')}) GROUP BY uid)"
    if isinstance(tree, Without):
        return f"(SELECT * FROM {matched(tree.left)} WHERE uid NOT IN (SELECT uid FROM {matched(tree.right)}))"
    parts = " UNION ALL ".join(f"SELECT *, {i} AS i FROM {matched(x)}" for i, x in enumerate(tree.parts))
    having = f"HAVING count(DISTINCT i) = {len(tree.parts)}" if isinstance(tree, Both) else ""
    return f"(SELECT uid, sum(score) AS score FROM ({parts}) GROUP BY uid {having})"


def ranked(tree, where: str = "", limit: int = 10) -> str:
    return f"""WITH {POSTINGS} SELECT row_number() OVER (ORDER BY m.score DESC, rowid, drawer_uid)::INTEGER AS rank, drawer_uid, round(m.score, 9) AS score
      FROM docs JOIN {matched(tree)} m ON m.uid = drawer_uid {where} ORDER BY m.score DESC, rowid, drawer_uid LIMIT {limit}"""


def search_query(name: str, raw: str, where: str = "", limit: int = 10, **filters) -> None:
    tree = parse(raw)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        drawers, stored_index = archive(spark, sf_dir)
        hidden = drawers.where("rowid % 7 = 0").select("drawer_uid", F.lit(1).alias("hidden_at"), F.lit(None).cast("long").alias("unhidden_at"), F.lit("").alias("reason")) if name == "bm25_hidden" else None
        found = Searcher(drawers, stored_index, hidden).search(raw, raw=True, limit=limit, **filters)
        return found.select("rank", "drawer_uid", F.round("score", 9).alias("score"))

    QUERIES[name], SQL[name] = run, ranked(tree, where, limit)


# ---- identity ----


@query(f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def norm_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_ws(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, sha256('wiki' || chr(31) || {norm('text')}) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.lit("wiki"), F.col("text")).alias("content_hash"))


@query(f"WITH {DOCS} SELECT rowid, drawer_uid FROM docs")
def drawer_uid(spark, sf_dir):
    return docs(spark, sf_dir).select("rowid", "drawer_uid")


@query(f"SELECT conv_id, turn, {keep('text')} AS keeps FROM conversations")
def skip_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.keeps(F.col("text")).alias("keeps"))


@query(f"WITH {CONV} SELECT drawer_uid, source, source_id, role, thread_id, parent_uid, position_in_thread, created_at, content_hash, content FROM conv")
def conv_drawers(spark, sf_dir):
    return conv(spark, sf_dir).select("drawer_uid", "source", "source_id", "role", "thread_id", "parent_uid", "position_in_thread", "created_at", "content_hash", "content")


@query(f"WITH {CONV} SELECT drawer_uid, parent_uid, position_in_thread FROM conv")
def thread_parent(spark, sf_dir):
    return conv(spark, sf_dir).select("drawer_uid", "parent_uid", "position_in_thread")


@query(f"WITH {CONV} SELECT a.drawer_uid, count(b.drawer_uid)::BIGINT AS branch_count FROM conv a LEFT JOIN conv b ON b.parent_uid = a.drawer_uid GROUP BY a.drawer_uid")
def branch_count(spark, sf_dir):
    return index.branch_counts(conv(spark, sf_dir))


#: Sources drop what follows the first digit, so that copies of a text in one group fall together.
DEDUP = f"SELECT doc_id, sha256('wiki' || chr(31) || {norm('text')}) AS content_hash, substr(source, 1, 4) AS source, 'all' AS source_id FROM documents"


@query(f"WITH d AS ({DEDUP}) SELECT doc_id, content_hash FROM d QUALIFY row_number() OVER (PARTITION BY content_hash, source, source_id ORDER BY doc_id) = 1")
def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.lit("wiki"), F.col("text")).alias("content_hash"), F.substring("source", 1, 4).alias("source"), F.lit("all").alias("source_id"))
    d = d.withColumn("drawer_uid", text.drawer_uid(F.col("source"), F.col("source_id"), F.col("content_hash")))
    return index.first_of_each(d, [F.col("doc_id")]).select("doc_id", "content_hash")


@query(f"WITH d AS ({DEDUP}), e AS (SELECT * FROM d WHERE doc_id % 2 = 0) SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND (content_hash, source) NOT IN (SELECT content_hash, source FROM e)")
def new_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.lit("wiki"), F.col("text")).alias("content_hash"), F.substring("source", 1, 4).alias("source"), F.lit("all").alias("source_id"))
    d = d.withColumn("drawer_uid", text.drawer_uid(F.col("source"), F.col("source_id"), F.col("content_hash")))
    return index.new_records(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


@query(
    """WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: true) AS lines FROM documents),
    m AS (SELECT doc_id, CASE WHEN lines[-1] = '' THEN lines[:-2] ELSE lines END AS lines FROM l),
    n AS (SELECT doc_id, lines, len(lines) AS n FROM m)
    SELECT doc_id, s + 1 AS first_line, array_to_string(lines[s + 1 : s + 50], chr(10)) AS chunk
    FROM n, unnest(range(0, (greatest(0, ceil((n - 50) / 45.0)) * 45)::BIGINT + 1, 45)) AS u(s) WHERE n > 0"""
)
def md_chunks(spark, sf_dir):
    from .sources.markdown import chunks

    d = table(spark, sf_dir, "documents").select("doc_id", chunks(text.lines(F.col("text")), 0).alias("chunks"))
    return d.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", F.col("c.first_line").cast("long").alias("first_line"), F.col("c.content").alias("chunk"))


@query("SELECT page_id, url, CASE WHEN list_contains(string_split(lower(url), '/'), 'memory') THEN 'memory' ELSE 'wiki' END AS role FROM pages")
def role_from_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", text.role_of_path(F.col("url")).alias("role"))


# ---- sources: the tables as the files that readers take ----

SESSION = "'00000000-0000-4000-8000-' || lpad(conv_id::VARCHAR, 12, '0')"


def _made(thread: str, source: str, source_id: str) -> str:
    """SQL of records of conversations that a reader finishes: filtered, numbered in their thread, hashed and chained."""
    return f"""WITH a AS (SELECT {thread} AS thread_id, {ROLE.replace("WHEN 'model' THEN 'assistant' ", "") if source == "claude_ai" else ROLE} AS role, text AS content, turn, (1700000000 + conv_id * 86400 + turn * 60)::BIGINT AS created_at FROM conversations),
    b AS (SELECT *, (row_number() OVER (PARTITION BY thread_id ORDER BY turn) - 1)::INTEGER AS position_in_thread, sha256(role || chr(31) || {norm('content')}) AS content_hash FROM a WHERE role IS NOT NULL AND {keep('content')}),
    c AS (SELECT *, {source_id} AS source_id FROM b), d AS (SELECT *, '{source}:' || source_id || ':' || substr(content_hash, 1, 12) AS drawer_uid FROM c)
    SELECT drawer_uid, source_id, role, thread_id, lag(drawer_uid) OVER (PARTITION BY thread_id ORDER BY turn) AS parent_uid, position_in_thread, created_at, content FROM d"""


READ = ("drawer_uid", "source_id", "role", "thread_id", "parent_uid", "position_in_thread", "created_at", "content")


def _conversation_files(spark, sf_dir, path: Column, message: Column, text_of: Callable[[Column], Column]) -> DataFrame:
    """Files (path, mtime, content) of whole conversations, their messages in order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(message).alias("line"))
    files = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return files.select(path.alias("path"), F.lit(5).cast("long").alias("mtime"), text_of(F.col("lines.line")).alias("content"))


def _time() -> Column:
    return F.col("conv_id") * 86_400 + F.col("turn") * 60 + 1_700_000_000


@query(_made(SESSION, "claude_code", "thread_id || ':' || position_in_thread"))
def session_logs(spark, sf_dir):
    message = F.struct(F.col("role").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"), (_time() * 1000).cast("double").alias("timestamp"))
    files = _conversation_files(spark, sf_dir, F.concat(F.lit("/logs/00000000-0000-4000-8000-"), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit(".jsonl")), message, lambda lines: F.array_join(lines, "\n"))
    return session_jsonl.parse(files).drawers.select(*READ)


@query(_made("'c' || conv_id", "claude_ai", "thread_id || ':' || turn"))
def chat_exports(spark, sf_dir):
    message = F.struct(F.col("role").alias("sender"), "text", F.date_format(F.timestamp_seconds(_time()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    whole = lambda lines: F.concat(F.lit('[{"uuid": "c'), F.col("conv_id").cast("string"), F.lit('", "chat_messages": ['), F.array_join(lines, ","), F.lit("]}]"))
    files = _conversation_files(spark, sf_dir, F.concat(F.lit("/export/"), F.col("conv_id").cast("string"), F.lit("/conversations.json")), message, whole)
    return export_json.parse(files).drawers.select(*READ)


def _exported(rows: DataFrame) -> str:
    """Write rows of one column, JSON texts, as exports, an array a task; the folder that holds them."""
    root = f"{scratch.folder(rows.sparkSession)}/tables/{uuid.uuid4().hex}"

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            for item in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([mark + item])], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])

    rows.mapInArrow(array, "value string").write.text(root)
    files = Files(rows.sparkSession, root)
    for part in files.names(root):  # a task's file gets the name that exports have
        if part.startswith("part-"):
            files.fs.mkdirs(files.path(f"{root}/{part[:10]}"))
            files.fs.rename(files.path(f"{root}/{part}"), files.path(f"{root}/{part[:10]}/conversations.json"))
    return root


@query(_made("'c' || conv_id", "claude_ai", "thread_id || ':' || turn"))
def export_files(spark, sf_dir):
    """The conversations as exports on disk, read from there in blocks, as large ones are."""
    message = F.struct(F.col("role").alias("sender"), "text", F.date_format(F.timestamp_seconds(_time()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    one = lambda lines: F.concat(F.lit('{"uuid": "c'), F.col("conv_id").cast("string"), F.lit('", "chat_messages": ['), F.array_join(lines, ","), F.lit("]}"))
    files = _conversation_files(spark, sf_dir, F.lit(""), message, one)
    return export_json.extract(spark, _exported(files.select("content")), large=1).drawers.select(*READ)


@query(
    f"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS lines FROM documents),
    m AS (SELECT doc_id, CASE WHEN lines[-1] = '' THEN lines[:-2] ELSE lines END AS lines FROM l),
    n AS (SELECT doc_id, lines, len(lines) AS n FROM m WHERE len(lines) > 0),
    c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'memory/' ELSE 'wiki/' END || doc_id || '.md' AS thread_id, CASE WHEN doc_id % 2 = 0 THEN 'memory' ELSE 'wiki' END AS role, s + 1 AS first_line, CASE WHEN n <= 40 THEN array_to_string(lines, chr(10)) ELSE array_to_string(lines[s + 1 : s + 50], chr(10)) END AS content
      FROM n, unnest(CASE WHEN n <= 40 THEN [0] ELSE range(0, (greatest(0, ceil((n - 50) / 45.0)) * 45)::BIGINT + 1, 45) END) AS u(s))
    SELECT 'markdown:' || thread_id || ':' || first_line || ':' || substr(sha256(role || chr(31) || {norm('content')}), 1, 12) AS drawer_uid, role, content FROM c WHERE {keep('content')}"""
)
def markdown_files(spark, sf_dir):
    """Files of more than 40 lines are cut; a tree's own limit is 1,000."""
    folder = F.when(F.col("doc_id") % 2 == 0, "memory").otherwise("wiki")
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/notes/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(5).cast("long").alias("mtime"), F.col("text").alias("content"))
    return markdown.parse(files, "/notes", whole=40).drawers.select("drawer_uid", "role", "content")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN 'caf' || chr(233) || ' ' || doc_id ELSE chr(8220) || 'quoted' || chr(8221) || ' ' || doc_id END AS decoded FROM documents")
def decode_bytes(spark, sf_dir):
    """Texts as bytes of UTF-8, UTF-16 with its mark, Latin-1 and Windows-1252."""
    i = F.col("doc_id").cast("string")
    content = F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 4 == 1, F.encode("text", "UTF-16"))
    content = content.when(F.col("doc_id") % 4 == 2, F.encode(F.concat(F.lit("caf\xe9 "), i), "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("\x93quoted\x94 "), i), "ISO-8859-1"))
    return table(spark, sf_dir, "documents").select("doc_id", text.decoded(content).alias("decoded"))


# ---- index ----


@query(f"WITH {DOCS} SELECT drawer_uid, array_to_string({TOKENS}, ' ') AS tokens FROM docs")
def tokenize(spark, sf_dir):
    return docs(spark, sf_dir).select("drawer_uid", F.array_join(text.tokens(F.col("content")), " ").alias("tokens"))


@query(f"WITH {POSTINGS} SELECT term, count(DISTINCT uid) AS df, count(*) AS tf FROM posts GROUP BY term")
def postings_df(spark, sf_dir):
    return index.vocabulary(docs(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT * FROM lens")
def doc_len(spark, sf_dir):
    return index.lengths(docs(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT n, round(average, 9) AS average FROM stats")
def corpus_stats(spark, sf_dir):
    return index.statistics(index.lengths(docs(spark, sf_dir))).select("n", F.round("average", 9).alias("average"))


@query(f"WITH {POSTINGS} SELECT term, count(DISTINCT uid) AS df FROM posts GROUP BY term ORDER BY df DESC, term LIMIT 50")
def vocab_topk(spark, sf_dir):
    return index.vocabulary(docs(spark, sf_dir)).select("term", "df").orderBy(F.desc("df"), "term").limit(50)


@query("SELECT event_type AS source, user_id::VARCHAR AS source_path, max(epoch(date_trunc('second', ts)))::BIGINT AS last_indexed_mtime, count(*) AS drawer_count FROM events GROUP BY 1, 2")
def index_state(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_path"), F.unix_timestamp("ts").alias("last_indexed_mtime"), F.lit(0).cast("long").alias("last_indexed_size"), F.lit(1).cast("long").alias("drawer_count"))
    return index.updated_state(seen.limit(0), seen).drop("last_indexed_size")


@query(
    """WITH f AS (SELECT event_type AS source, user_id::VARCHAR AS source_path, max(epoch(date_trunc('second', ts)))::BIGINT AS mtime FROM events GROUP BY 1, 2),
    s AS (SELECT source, source_path, mtime - (mtime % 2) AS seen FROM f WHERE source_path::BIGINT % 3 <> 0)
    SELECT f.* FROM f LEFT JOIN s USING (source, source_path) WHERE seen IS NULL OR mtime > seen"""
)
def stale_files(spark, sf_dir):
    files = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_path")).agg(F.max(F.unix_timestamp("ts")).alias("mtime"))
    state = files.where("cast(source_path AS BIGINT) % 3 <> 0").select("source", "source_path", (F.col("mtime") - F.col("mtime") % 2).alias("last_indexed_mtime"))
    return index.needs_index(files, state)


# ---- search ----

search_query("bm25_term", "the")
search_query("bm25_phrase", '"of the"')
search_query("bm25_or", "of OR und")
search_query("bm25_and", "the AND license")
search_query("bm25_not", "the NOT license")
search_query("bm25_prefix", "lic*")
search_query("bm25_near", "NEAR(license the, 3)")
search_query("bm25_initial", "^the")
search_query("bm25_nested", '(license OR token) NOT ("of the" AND und)')
search_query("bm25_repeat", "license OR license")
search_query("bm25_filtered", "the", "WHERE source IN ('src1', 'src2') AND created_at BETWEEN 1700000060 AND 1700030000", source=["src1", "src2"], since=1_700_000_060, until=1_700_030_000)
search_query("bm25_hidden", "the", "WHERE rowid % 7 <> 0")
search_query("bm25_ties", "license", "", 1000)

BATCH = "SELECT item_id AS qid, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+')[3:5] AS terms FROM benchmark"
BATCH_HITS = f"""{POSTINGS}, q AS ({BATCH}), w AS (SELECT qid, terms[1] AS a, terms[2] AS b, terms[3] AS c FROM q),
hits AS (SELECT qid, p.uid, count(*) AS tf FROM w JOIN posts p ON p.term = a JOIN posts r ON r.uid = p.uid AND r.pos = p.pos + 1 AND r.term = b JOIN posts s ON s.uid = p.uid AND s.pos = p.pos + 2 AND s.term = c GROUP BY ALL),
scores AS (SELECT h.qid, h.uid, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score
  FROM hits h JOIN (SELECT qid, count(*) AS df FROM hits GROUP BY qid) f USING (qid) JOIN lens ON lens.uid = h.uid, stats),
top AS (SELECT qid, uid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid)::INTEGER AS rank FROM scores QUALIFY rank <= 10)"""


def batch_scores(spark, sf_dir) -> DataFrame:
    """A three-word phrase, the feature shown, of each benchmark item, against all documents."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.slice(text.tokens(F.col("text")), 3, 3).alias("terms"))
    return archive(spark, sf_dir)[1].match_all(queries)


@query(f"WITH {BATCH_HITS} SELECT qid, rank, uid, round(score, 9) AS score FROM top")
def bm25_batch(spark, sf_dir):
    return top_per_query(batch_scores(spark, sf_dir), 10).select("qid", "rank", "uid", F.round("score", 9).alias("score"))


WHOLE_HITS = f"""{POSTINGS}, q AS (SELECT item_id AS qid, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}]+') AS terms FROM benchmark),
hits AS (SELECT qid, p.uid, count(*) AS tf FROM q JOIN posts p ON p.term = terms[1] JOIN toks ON toks.uid = p.uid WHERE t[p.pos + 1 : p.pos + len(terms)] = terms GROUP BY ALL)
SELECT h.qid, h.uid, tf, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 9) AS score
  FROM hits h JOIN (SELECT qid, count(*) AS df FROM hits GROUP BY qid) f USING (qid) JOIN lens ON lens.uid = h.uid, stats"""


@query(f"WITH w AS (WITH {WHOLE_HITS}) SELECT qid, uid, score FROM w")
def bm25_whole(spark, sf_dir):
    """Every benchmark item's whole text as a phrase."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), text.tokens(F.col("text")).alias("terms"))
    return archive(spark, sf_dir)[1].match_all(queries).select("qid", "uid", F.round("score", 9).alias("score"))


FLAT = norm("text")
AT = f"nullif(least(CASE WHEN instr(lower({FLAT}), 'license') > 0 THEN instr(lower({FLAT}), 'license') ELSE 999999999 END, CASE WHEN instr(lower({FLAT}), 'und') > 0 THEN instr(lower({FLAT}), 'und') ELSE 999999999 END), 999999999) - 1"


@query(
    f"""WITH f AS (SELECT doc_id, {FLAT} AS flat, {AT} AS hit FROM documents),
    g AS (SELECT doc_id, flat, coalesce(greatest(hit - 80, 0), 0) AS s, coalesce(least(length(flat), hit + 120, coalesce(greatest(hit - 80, 0), 0) + 200), least(length(flat), 200)) AS e FROM f)
    SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || substr(flat, s + 1, e - s) || CASE WHEN e < length(flat) THEN '...' ELSE '' END AS snippet FROM g"""
)
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), text.query_terms("license OR und")).alias("snippet"))


@query(f"SELECT doc_id, {AT} AS first_match FROM documents")
def match_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_match(text.normalize_ws(F.col("text")), ["license", "und"]).cast("long").alias("first_match"))


@query("SELECT doc_id, regexp_replace(text, '(license|token)', chr(27) || '[1m\\1' || chr(27) || '[0m', 'gi') AS full_text FROM documents")
def bold_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.bold(F.col("text"), ["token", "license"]).alias("full_text"))


@query("SELECT doc_id, regexp_replace('x' || chr(27) || '[1m' || text || chr(27) || '[0m', chr(27) || '\\[[0-9;]*m', '', 'g') AS clean FROM documents")
def ansi_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.without_ansi(F.concat(F.lit("x" + text.BOLD), F.col("text"), F.lit(text.PLAIN))).alias("clean"))


@query(f"WITH {DOCS} SELECT drawer_uid, role, content FROM docs WHERE drawer_uid = (SELECT min(drawer_uid) FROM docs)")
def fetch_uid(spark, sf_dir):
    drawers, stored_index = archive(spark, sf_dir)
    first = drawers.agg(F.min("drawer_uid")).first()[0]
    return Searcher(drawers, stored_index).fetch(first).select("drawer_uid", "role", "content")


@query(f"WITH {DOCS} SELECT drawer_uid FROM docs WHERE starts_with(lower(drawer_uid), '12') OR contains(lower(drawer_uid), ':12')")
def prefix_resolve(spark, sf_dir):
    return ops.prefix_matches(stored(spark, sf_dir), "12").select("drawer_uid")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND doc_id >= 10 AND doc_id <= 900 AND lang = 'en'")
def metadata_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("created_at"), F.col("lang").alias("register"), F.lit("wiki").alias("role"))
    return filtered(d, source=["src1", "", "src3"], since=10, until=900, register="en", role="wiki", unknown=1).select("doc_id")


@query(
    f"""WITH {POSTINGS}, best AS (SELECT drawer_uid, content, row_number() OVER (ORDER BY m.score DESC, rowid, drawer_uid) AS b FROM docs JOIN {matched(Phrase(('license',)))} m ON m.uid = drawer_uid QUALIFY b <= 30)
    SELECT drawer_uid, length(content)::DOUBLE AS score, row_number() OVER (ORDER BY length(content) DESC, b)::INTEGER AS rank FROM best ORDER BY score DESC, b LIMIT 10"""
)
def rerank_stub(spark, sf_dir):
    order = Window.orderBy(F.desc("score"), "rowid", "drawer_uid")
    best = Searcher(*archive(spark, sf_dir)).matches("license").orderBy(F.desc("score"), "rowid", "drawer_uid").limit(30).withColumn("rank", F.row_number().over(order))
    return rerank(best, "license", lambda: lambda pairs: [float(len(c)) for _, c in pairs], 10).select("drawer_uid", "score", "rank")


# ---- risk ----


def risk_query(name: str, expression: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", risk.counts(F.col("text"))[name.removeprefix("risk_")].cast("long").alias("n"))

    QUERIES[name], SQL[name] = run, f"SELECT doc_id, ({expression})::BIGINT AS n FROM documents"


def removed(letters: str) -> str:
    listed = " || ".join(f"chr({ord(c)})" for c in letters if ord(c))
    return f"length(text) - length(translate(text, {listed}, ''))"


def re2(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?iU:", "(?i:").replace("(?U)", "")


SEEN = "translate(text, " + " || ".join(f"chr({ord(c)})" for c in risk.BIDI + risk.ZERO_WIDTH + risk.CONTROL if ord(c)) + ", '')"
JAILBREAK = " + ".join(f"len(regexp_extract_all({SEEN}, '{re2(p)}'))" for p in risk.TEMPLATES.values())
CONFUSABLE = f"len(list_distinct(list_filter(regexp_split_to_array({SEEN}, '{text.WS}+'), lambda w: (regexp_matches(w, '[A-Za-z]')::INT + regexp_matches(w, '[\\x{{400}}-\\x{{4ff}}]')::INT + regexp_matches(w, '[\\x{{370}}-\\x{{3ff}}]')::INT) >= 2)))"
KINDS = {"risk_bidi": removed(risk.BIDI), "risk_zero_width": removed(risk.ZERO_WIDTH), "risk_control": removed(risk.CONTROL), "risk_jailbreak": JAILBREAK, "risk_confusable": CONFUSABLE}
for _name, _sql in KINDS.items():
    risk_query(_name, _sql)


@query(
    "WITH s AS (SELECT doc_id, least(100, " + " + ".join(f"({sql}) * {risk.POINTS[k.removeprefix('risk_')]}" for k, sql in KINDS.items()) + ")::BIGINT AS total FROM documents) "
    "SELECT doc_id, total, CASE WHEN total >= 10 THEN 'BLOCKER' WHEN total >= 5 THEN 'MAJOR' WHEN total >= 1 THEN 'MINOR' ELSE 'CLEAN' END AS band FROM s"
)
def risk_total_band(spark, sf_dir):
    total = risk.total(risk.counts(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", total.cast("long").alias("total"), risk.band(total).alias("band"))


@query()
def risk_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", risk.report(F.col("text")).alias("r")).select("doc_id", "r.*")


# ---- graph ----

SEEDS = [("Apache License", "concept", ["MIT License"]), ("password", "concept", ["token"]), ("GNU", "project", ["General Public License"]), ("CC BY-NC", "concept", [])]


def _seed_sql(name: str, type_: str, aliases: list[str]) -> str:
    return f"SELECT drawer_uid, '{name}' AS name, '{type_}' AS type FROM docs WHERE regexp_matches(content, '(?i)(^|[^\\w])({'|'.join([name, *aliases])})([^\\w]|$)')"


@query(f"WITH {DOCS} {' UNION ALL '.join(_seed_sql(*s) for s in SEEDS)}")
def link_seeds(spark, sf_dir):
    return graph.link(stored(spark, sf_dir), SEEDS)


@query(
    f"""WITH {DOCS}, s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS name FROM benchmark),
    w AS (SELECT DISTINCT drawer_uid, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+')) AS name FROM docs)
    SELECT drawer_uid, name, 'term' AS type FROM w JOIN s USING (name)"""
)
def link_dictionary(spark, sf_dir):
    """Every word of seven letters or more of the benchmark as a seed."""
    names = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    seeds = table(spark, sf_dir, "benchmark").select(names.alias("name")).distinct().select("name", F.lit("term").alias("type"), F.lit(None).cast("array<string>").alias("aliases"))
    return graph.link_all(stored(spark, sf_dir), seeds)


@query(
    """WITH o AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'project' ELSE 'concept' END AS type, c_custkey AS seen FROM customer)
    SELECT row_number() OVER (ORDER BY min(seen), arg_min(name, seen), type)::BIGINT AS id, arg_min(name, seen) AS name, type, min(seen) AS first_seen, max(seen) AS last_seen FROM o GROUP BY lower(name), type"""
)
def entity_upsert(spark, sf_dir):
    from .schemas import empty

    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    observed = c.select(name.alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "project").otherwise("concept").alias("type"), F.lit(None).cast("string").alias("metadata"), F.lit("seed").alias("source"), F.col("c_custkey").alias("at"))
    return graph.upsert_entities(empty(spark, "entities"), observed).select("id", "name", "type", "first_seen", "last_seen")


def _graph(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entity = lambda df, i, name: df.select(F.col(i).cast("long").alias("id"), F.col(name).alias("name"), F.lit("place").alias("type"))
    entities = entity(n, "n_nationkey", "n_name").union(entity(r.withColumn("id", F.col("r_regionkey") + 1000), "id", "r_name"))
    drawers = stored(spark, sf_dir)
    mentions = drawers.select("drawer_uid", (F.col("rowid") % 25).alias("entity_id"), F.lit(1.0).alias("confidence"), F.lit("linker").alias("detected_by"), (F.col("rowid") % 10).alias("detected_at"))
    edges = n.select(F.col("n_nationkey").cast("long").alias("subject_id"), F.lit("PART_OF").alias("predicate"), (F.col("n_regionkey") + 1000).cast("long").alias("object_id"), F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit(None).cast("string").alias("drawer_uid"))
    return entities, mentions, edges, drawers


@query(f"WITH {DOCS}, u AS (SELECT min(drawer_uid) AS uid FROM docs) SELECT n_nationkey::BIGINT AS id, n_name AS name FROM docs JOIN u ON drawer_uid = uid JOIN nation ON n_nationkey = rowid % 25")
def entities_for_drawer(spark, sf_dir):
    entities, mentions, _, drawers = _graph(spark, sf_dir)
    first = drawers.agg(F.min("drawer_uid")).first()[0]
    return graph.entities_of(first, entities, mentions).select("id", "name")


@query(f"WITH {DOCS} SELECT drawer_uid FROM docs WHERE rowid % 25 = 3 ORDER BY rowid % 10 DESC, drawer_uid LIMIT 20")
def drawers_for_entity(spark, sf_dir):
    return graph.drawers_of(3, _graph(spark, sf_dir)[1], 20)


@query(
    f"""WITH {DOCS}, m AS (SELECT rowid % 25 AS e, drawer_uid, row_number() OVER (PARTITION BY rowid % 25 ORDER BY rowid % 10 DESC, drawer_uid) AS k FROM docs QUALIFY k <= 5)
    SELECT n_nationkey::BIGINT AS id, n_name AS name, (SELECT string_agg(drawer_uid, ',' ORDER BY k) FROM m WHERE e = n_nationkey) AS mentions, 'PART_OF>' || r_name AS relationships
    FROM nation JOIN region ON r_regionkey = n_regionkey WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation)"""
)
def graph_query(spark, sf_dir):
    entities, mentions, edges, drawers = _graph(spark, sf_dir)
    name = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    found = graph.neighbourhood(name.swapcase(), entities, mentions, edges, drawers, 5)
    return found.select("id", "name", F.array_join(F.transform("mentions", lambda m: m["drawer_uid"]), ",").alias("mentions"), F.array_join(F.transform("relationships", lambda r: F.concat_ws(">", r["predicate"], r["object"])), ",").alias("relationships"))


@query("SELECT n_nationkey::BIGINT AS subject_id, r_name AS object FROM nation JOIN region ON r_regionkey = n_regionkey")
def rel_by_predicate(spark, sf_dir):
    entities, _, edges, _ = _graph(spark, sf_dir)
    return graph.relations(entities, edges, "PART_OF").select("subject_id", "object")


# ---- ops ----


@query(f"WITH {DOCS} SELECT source, count(*) AS n FROM docs GROUP BY source")
def status_by_source(spark, sf_dir):
    return ops.by_source(stored(spark, sf_dir))


@query(f"WITH {DOCS} SELECT count(*) AS drawer_count, count(DISTINCT source) AS source_count, 2 AS schema_version, max(epoch(date_trunc('second', ts)))::BIGINT AS last_indexed, any_value(e.n) AS error_count FROM docs, (SELECT max(ts) AS ts FROM events), (SELECT count(*) AS n FROM events WHERE value < 0.5) e")
def status_summary(spark, sf_dir):
    from .schemas import seeds

    events = table(spark, sf_dir, "events")
    return ops.summary(stored(spark, sf_dir), seeds(spark, 0)["schema_version"], events.select(F.unix_timestamp("ts").alias("last_indexed_mtime")), events.where("value < 0.5")).drop("applied_at")


@query("SELECT event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS occurred_at FROM events ORDER BY occurred_at DESC, id DESC LIMIT 50")
def errors_latest(spark, sf_dir):
    return ops.latest_errors(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("occurred_at")))


REASONS = ("Bad JSONL at line 3", "non-object message in x", "conversation y has no message array", "conversation without uuid", "Invalid JSON", "cannot determine session UUID", "Failed to read z", "expected top-level JSON array", "something else")


@query("SELECT event_id, CASE event_id % 9 " + " ".join("WHEN {} THEN '{}'".format(i, h.replace("'", "''")) for i, (_, h) in enumerate(text.HINTS)) + " END AS fix_hint FROM events")
def fix_hints(spark, sf_dir):
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.fix_hint(reason).alias("fix_hint"))


@query(f"SELECT sha256('wiki' || chr(31) || {norm('text')}) AS drawer_uid, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1")
def verify_dups(spark, sf_dir):
    return ops.duplicate_uids(table(spark, sf_dir, "documents").select(text.content_hash(F.lit("wiki"), F.col("text")).alias("drawer_uid")))


@query("SELECT 'labels' AS child, 'doc_id' AS \"column\", doc_id::VARCHAR AS value FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)")
def verify_orphans(spark, sf_dir):
    tables = {"labels": table(spark, sf_dir, "labels"), "documents": table(spark, sf_dir, "documents").where("doc_id % 5 <> 0")}
    return ops.orphans(tables, [("labels", "doc_id", "documents", "doc_id")])


@query(f"WITH {DOCS} SELECT 'empty_uid' AS \"check\", 0::BIGINT AS n UNION ALL SELECT 'bad_hash', 0 UNION ALL SELECT 'duplicate_uid', 0 UNION ALL SELECT 'index_without_drawer', count(*) FROM docs WHERE rowid % 11 = 0")
def verify_hash_len(spark, sf_dir):
    drawers, stored_index = archive(spark, sf_dir)
    return ops.verify(drawers.where("rowid % 11 <> 0"), stored_index.lengths)


@query(
    f"""WITH {DOCS}, h AS (SELECT drawer_uid, 100 AS hidden_at, CASE WHEN rowid % 2 = 0 THEN 150 END AS unhidden_at, 'old' AS reason FROM docs WHERE rowid % 3 = 0)
    SELECT drawer_uid, CASE WHEN rowid % 5 = 0 THEN 200 ELSE hidden_at END::BIGINT AS hidden_at, CASE WHEN rowid % 5 <> 0 THEN unhidden_at END::BIGINT AS unhidden_at, CASE WHEN rowid % 5 = 0 THEN 'new' ELSE reason END AS reason
    FROM docs LEFT JOIN h USING (drawer_uid) WHERE rowid % 5 = 0 OR rowid % 3 = 0"""
)
def forget_upsert(spark, sf_dir):
    d = stored(spark, sf_dir)
    hidden = d.where("rowid % 3 = 0").select("drawer_uid", F.lit(100).cast("long").alias("hidden_at"), F.expr("CASE WHEN rowid % 2 = 0 THEN 150 END").cast("long").alias("unhidden_at"), F.lit("old").alias("reason"))
    return ops.hide(hidden, d.where("rowid % 5 = 0").select("drawer_uid", F.lit(200).cast("long").alias("hidden_at"), F.lit("new").alias("reason")))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^.*3.*$') AND regexp_matches(url, '^http.*[0-9]$')")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(glob_condition(F.col("url"), F.col("url"), ["http*[0-9]"], ["*3*"])).select("page_id")


@query("SELECT o_orderkey, strftime(to_timestamp(epoch(o_orderdate)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, (epoch(date_trunc('day', o_orderdate)) + 86399)::BIGINT AS until FROM orders")
def dates(spark, sf_dir):
    day = text.date_of_epoch(F.unix_timestamp("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), text.epoch_of_date(day, True).alias("until"))


# ---- extraction ----


@query("SELECT doc_id, greatest(1, floor(length(text) / 3.0))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extraction.token_estimate(F.col("text")).alias("tokens"))


MODELS = [*extraction.PRICES, "another"]
PRICED = "(VALUES " + ", ".join(f"({i}, '{m}', {(extraction.PRICES.get(m) or extraction.OTHER_PRICE)[0]}, {(extraction.PRICES.get(m) or extraction.OTHER_PRICE)[1]})" for i, m in enumerate(MODELS)) + ") p(i, model, a, b)"


@query(f"SELECT event_id, model, round(user_id / 1e6 * a + event_id / 1e6 * b, 9) AS cost_usd FROM events JOIN {PRICED} ON i = event_id % 8")
def cost_estimate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 8 + 1).cast("int")).alias("model"), F.col("user_id").alias("tokens_input"), F.col("event_id").alias("tokens_output"))
    return extraction.with_cost(e).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query("WITH q AS (SELECT event_id, sum(event_id % 97) OVER (ORDER BY date_trunc('second', ts), event_id::VARCHAR) AS spent FROM events) SELECT event_id, spent::DOUBLE AS spent_usd FROM q WHERE spent <= 2000")
def budget_prefix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("drawer_uid"), F.unix_timestamp("ts").alias("enqueued_at"), (F.col("event_id") % 97).cast("double").alias("cost_usd"))
    return extraction.within_budget(e, 2000).select("event_id", "spent_usd")


@query("SELECT event_id::VARCHAR AS drawer_uid FROM events ORDER BY date_trunc('second', ts), drawer_uid LIMIT 25")
def pending_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("drawer_uid"), F.unix_timestamp("ts").alias("enqueued_at"))
    return extraction.next_pending(e, 25).select("drawer_uid")


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("drawer_uid"), F.col("event_type").alias("status"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.unix_timestamp("ts").alias("started_at"), (F.col("event_id") % 8).cast("double").alias("cost_usd"))


@query("SELECT user_id::VARCHAR AS drawer_uid, count(*) AS run_count, sum(event_id % 8)::DOUBLE AS total_cost_usd FROM events GROUP BY 1")
def run_status(spark, sf_dir):
    return extraction.run_status(_runs(spark, sf_dir)).select("drawer_uid", "run_count", "total_cost_usd")


@query("SELECT user_id::VARCHAR AS drawer_uid, event_id AS id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_id DESC) = 1")
def latest_run(spark, sf_dir):
    return extraction.run_status(_runs(spark, sf_dir)).select("drawer_uid", "id", "status")


@query("SELECT event_id, CASE WHEN event_type IN ('success', 'partial', 'failed', 'budget_exhausted') THEN event_type ELSE 'failed' END AS status FROM events")
def run_coercion(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", extraction.status_or_failed(F.col("event_type")).alias("status"))


@query("SELECT doc_id, 'Extract: ' || text || '.' AS prompt FROM documents")
def prompt_render(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extraction.render(F.lit("Extract: {content}."), F.col("text")).alias("prompt"))


@query()
def response_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('So: {"entities": ['), F.col("props"), F.lit("]} done"))).otherwise(F.col("props"))
    return e.select("event_id", extraction.parsed(answer).alias("r")).select("event_id", "r.*")


# ---- evaluation ----


@query(
    f"""WITH {BATCH_HITS}, e AS (SELECT q.qid, min(h.uid) AS uid FROM q JOIN hits h ON h.qid = q.qid GROUP BY q.qid), f AS (SELECT e.qid, rank FROM e LEFT JOIN top ON top.qid = e.qid AND top.uid = e.uid)
    SELECT count(*) AS n_queries, round(count(rank) / count(*) / 10, 9) AS precision_at_k, round(count(rank) / count(*), 9) AS recall_at_k, round(sum(coalesce(1 / rank, 0)) / count(*), 9) AS mrr FROM f"""
)
def precision_recall_mrr(spark, sf_dir):
    scored_ = batch_scores(spark, sf_dir)
    expected = scored_.groupBy("qid").agg(F.min("uid").alias("uid"))
    found = evaluate.quality(expected, top_per_query(scored_, 10))
    return found.select("n_queries", *[F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")])


@query(
    f"""WITH {BATCH_HITS}, i AS (SELECT item_id AS qid, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}]+'), ' ') || ' ' AS item FROM benchmark),
    e AS (SELECT qid, min(uid) AS uid FROM i JOIN toks ON contains(' ' || array_to_string(t, ' ') || ' ', item) WHERE trim(item) <> '' GROUP BY qid), f AS (SELECT e.qid, rank FROM e LEFT JOIN top ON top.qid = e.qid AND top.uid = e.uid)
    SELECT count(*) AS n_queries, round(count(rank) / count(*) / 10, 9) AS precision_at_k, round(count(rank) / count(*), 9) AS recall_at_k, round(sum(coalesce(1 / rank, 0)) / count(*), 9) AS mrr FROM f"""
)
def known_item_quality(spark, sf_dir):
    """How well a phrase of three words finds a document that holds the whole benchmark passage, known from the texts and not from the index."""
    words = lambda c: F.array_join(text.tokens(F.col(c)), " ")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), words("text").alias("words"))
    rows = archive(spark, sf_dir)[1].texts.select("uid", F.array_join("tokens", " ").alias("words"))
    known = dictionary.find(rows, "uid", "words", items).groupBy(F.col("entry").alias("qid")).agg(F.min("uid").alias("uid"))
    found = evaluate.quality(known, top_per_query(batch_scores(spark, sf_dir), 10))
    return found.select("n_queries", *[F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")])


@query("SELECT round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM events")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value")

