"""Queries over the driver's tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import frontmatter, paths, properties
from vellum.operators import changes, chunks, events, search, sinks
from vellum import scratch
from vellum.plans import index, registry
from vellum.plans.notes import NOTES_SQL, PLACED_SQL, documents, notes, placed
from vellum.sources import tree

PLAN = registry.STRATEGIES["obsidian"]
NAMES = ("", ".", "..", "a/b", "a\\b", "My-Vault", "...", " ", "é")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).withColumn("s", frontmatter.split(frontmatter.unix_lines(F.col("note")))).select("doc_id", "s.*")


def frontmatter_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "status", "front_matter", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.col("lines_before").cast("long").alias("lines_before"))


def frontmatter_status_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("status").agg(F.count("*").alias("notes"))


def extension_mime(spark, sf_dir):
    ext = paths.extension(F.col("rel_path"))
    return placed(spark, sf_dir).select("doc_id", "rel_path", ext.alias("extension"), paths.mime_type(ext).alias("mime_type"))


def skip_dir_prune(spark, sf_dir):
    path = F.col("rel_path")
    return placed(spark, sf_dir).select("doc_id", "rel_path", paths.below_skipped(path, PLAN.skip_directories).alias("skipped"), paths.first_skipped(path, PLAN.skip_directories).alias("skipped_dir"))


def _visible(spark, sf_dir):
    path = F.col("rel_path")
    return placed(spark, sf_dir).where(~paths.below_skipped(path, PLAN.skip_directories)).withColumn("extension", paths.extension(path))


def _formats(spark):
    return F.broadcast(spark.createDataFrame([(x,) for x in PLAN.extensions()], "extension string"))  # a row a parser


def format_kept(spark, sf_dir):
    return _visible(spark, sf_dir).join(_formats(spark), "extension", "left_semi").select("doc_id", "rel_path", "extension")


def format_skipped(spark, sf_dir):
    return _visible(spark, sf_dir).join(_formats(spark), "extension", "left_anti").select("doc_id", "rel_path", "extension")


def index_stats(spark, sf_dir):
    path = F.col("rel_path")
    hidden, kept = paths.below_skipped(path, PLAN.skip_directories), paths.extension(path).isin(PLAN.extensions())
    return placed(spark, sf_dir).agg(
        F.count_distinct(paths.first_skipped(path, PLAN.skip_directories)).alias("dirs_skipped"),
        F.count_if(~hidden & ~kept).alias("docs_skipped"),
        F.count_if(~hidden & kept).alias("docs_prepared"),
        F.lit(0).cast("long").alias("docs_failed"),
    )


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with position from 0 in a total order: ranges are sorted apart, and their counts give the offsets."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for k in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("part") + 1)
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long") - 1
    return ranged.withColumn("position", offset + own).drop("part")


def walk_order(spark, sf_dir):
    return numbered(placed(spark, sf_dir), paths.walk_key(F.col("rel_path")))


def relpath_containment(spark, sf_dir):
    places = placed(spark, sf_dir).select("doc_id", F.element_at(F.array(*[F.lit(x) for x in ("/vault/", "/vault/x/../", "/other/", "/vaulted/", "/vault/./")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("base"), "rel_path")
    full = places.withColumn("path", paths.normalized(F.concat("base", "rel_path")))
    relative = full.withColumn("relative", paths.relative_path(F.col("path"), F.lit("/vault")))
    return relative.select("doc_id", "path", "relative", paths.is_local(F.col("relative")).alias("local"))


def repo_name_valid(spark, sf_dir):
    fixed = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = fixed.unionByName(documents(spark, sf_dir).select(F.concat("source", F.lit("/"), "lang").alias("name"))).unionByName(documents(spark, sf_dir).select(F.col("source").alias("name")))
    return found.distinct().select("name", paths.valid_repo_name(F.col("name")).alias("valid"))


def repo_list_json(spark, sf_dir):
    name = F.col("source")
    repos = documents(spark, sf_dir).groupBy(name.alias("name")).agg(F.lit("obsidian").alias("application"))
    rows = repos.withColumns({"directory": F.concat(F.lit("/vaults/"), "name"), "config": F.concat(F.lit("/c/repos/"), "name", F.lit("/config.yaml")), "db": F.concat(F.lit("/c/repos/"), "name", F.lit("/vellum.db"))})
    return sinks.repos_json(rows)


def _properties(spark, sf_dir):
    return _split(spark, sf_dir).withColumn("p", properties.properties(F.col("front_matter"))).select("doc_id", "status", F.col("p.properties_json").alias("properties_json"), F.coalesce(frontmatter.error(F.col("status")), F.col("p.error")).alias("parse_error"))


def properties_get(spark, sf_dir):
    v = F.try_parse_json("properties_json")
    get = lambda key, kind: F.try_variant_get(v, f"$.{key}", kind).alias(f"note_{key}")
    return _properties(spark, sf_dir).select("doc_id", get("title", "string"), get("status", "string"), get("source", "string"), get("rating", "long"), F.col("parse_error").isNotNull().alias("failed"))


def document_events(spark, sf_dir):
    entries = placed(spark, sf_dir).join(_properties(spark, sf_dir).select("doc_id", "parse_error"), "doc_id")
    entries = entries.withColumn("hidden", paths.first_skipped(F.col("rel_path"), PLAN.skip_directories))
    hidden = F.col("hidden")
    whole = entries.select(F.coalesce(hidden, "rel_path").alias("rel_path"), F.when(hidden.isNotNull(), "dir-skipped").otherwise("file").alias("entry"), F.when(hidden.isNull(), F.col("parse_error")).alias("parse_error")).distinct()
    whole = whole.withColumns({"path": F.concat(F.lit("/vault/"), "rel_path"), "extension": paths.extension(F.col("rel_path")), "stat_error": F.lit(None).cast("string"), "is_regular": F.lit(True), "error": F.lit(None).cast("string")})
    kept = whole.where((F.col("entry") == "file") & F.col("extension").isin(PLAN.extensions()))
    return events.events(whole, kept, PLAN.extensions()).select("rel_path", F.col("step").cast("long").alias("step"), "kind", "error", "delivered")


def document_json(spark, sf_dir):
    at = placed(spark, sf_dir).join(_properties(spark, sf_dir).select("doc_id", "properties_json"), "doc_id")
    rows = at.select("doc_id", F.lit("obsidian").alias("app_type"), F.lit(None).cast(chunks.TYPE).alias("chunks"), paths.extension(F.col("rel_path")).alias("extension"), paths.base_name(F.col("rel_path")).alias("name"), F.try_parse_json("properties_json").alias("properties"), "rel_path")
    return rows.select("doc_id", sinks.document_json(rows).alias("json"))


def _chunks(spark, sf_dir):
    cut = _split(spark, sf_dir).withColumn("chunks", chunks.chunks(F.col("body"), F.col("lines_before")))
    return chunks.exploded(cut, "doc_id")


def heading_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.array_join("heading_path", " > ").alias("heading_path"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def chunk_embedding_input(spark, sf_dir):
    text = chunks.embedding_input(F.col("heading_path"), F.col("text"))
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("input_md5"))


def chunk_vectors(spark, sf_dir):
    """Chunks with the entries of their vectors, as they are stored, that are not zero."""
    cut = _chunks(spark, sf_dir).withColumn("vector", search.embed(chunks.embedding_input(F.col("heading_path"), F.col("text"))))
    rows = cut.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.posexplode("vector").alias("place", "value"))
    return rows.where(F.col("value") != 0).select("doc_id", "chunk_no", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 4).alias("value"))


def index_outcomes(spark, sf_dir):
    """What becomes of every kept file: failures before and while reading, doubts of the parser."""
    entries, places = _entries(spark, sf_dir), F.col("doc_id")
    kept = index.classified(entries, PLAN).join(notes(spark, sf_dir), "doc_id")
    read = kept.withColumns({"content": F.when(F.col("error").isNull() & (places % 17 != 0), F.col("note").cast("binary")), "read_error": F.when(F.col("error").isNull() & (places % 17 == 0), F.lit("unreadable"))})
    return index.parsed(read.drop("note"), PLAN).select("doc_id", "rel_path", "error", F.when(F.col("error").isNull(), F.col("parse_error")).alias("parse_error"))


def _entries(spark, sf_dir):
    number = F.col("doc_id")
    return placed(spark, sf_dir).where(~paths.below_skipped(F.col("rel_path"), PLAN.skip_directories)).withColumns({
        "entry": F.lit("file"), "path": F.concat(F.lit("/vault/"), "rel_path"), "extension": paths.extension(F.col("rel_path")), "size": F.lit(1).cast("long"),
        "stat_error": F.when(number % 13 == 0, F.lit("no such file")), "is_regular": F.when(number % 13 != 0, number % 19 != 0),
        "rel_path": F.when(number % 23 == 0, F.concat(F.lit("../"), "rel_path")).otherwise(F.col("rel_path")),
    })


def index_failures(spark, sf_dir):
    """The four counters where some files fail."""
    done = index_outcomes(spark, sf_dir)
    return index.stats(_entries(spark, sf_dir), done, PLAN)


def properties_rich(spark, sf_dir):
    """Front matter with lists, maps, dates, floats, quotes and duplicate keys, as canonical JSON."""
    n = F.col("doc_id")
    text = F.concat(
        F.lit("tags: [a"), n, F.lit(", 'b c']\nwhen: 2024-02-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("\nratio: "), (n % 10).cast("string"), F.lit(".5\nnested:\n  on: yes\n  deep: {k: null, z: true}\nsize: 0x"),
        F.lower(F.hex(n)), F.lit("\nquoted: \"7\"\n"), F.when(n % 9 == 0, F.lit("ratio: 1\n")).otherwise(""),
    )
    found = documents(spark, sf_dir).select("doc_id", properties.properties(text).alias("p"))
    return found.select("doc_id", F.col("p.properties_json").alias("properties_json"), F.col("p.error").isNotNull().alias("failed"))


def embedding_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.top_k(rows, rows.where(F.col("vec_id") % 20 == 0)).select("query_id", "neighbor_id", "similarity", F.col("rank").cast("long").alias("rank"))


def embedding_topk_filtered(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=5, where=F.col("label") % 2 == 0).select("query_id", "neighbor_id", "similarity", F.col("rank").cast("long").alias("rank"))


def incremental_changes(spark, sf_dir):
    now = placed(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.length("text").alias("size")), "doc_id")
    zero = F.timestamp_seconds(F.lit(0))
    before = now.where(F.col("doc_id") % 10 != 1).select(F.col("rel_path").alias("path"), (F.col("size") + F.when(F.col("doc_id") % 10 == 2, 1).otherwise(0)).alias("size"), zero.alias("mod_time"))
    after = now.where(F.col("doc_id") % 10 != 3).select(F.col("rel_path").alias("path"), "size", zero.alias("mod_time"))
    return changes.changes(before, after)


def file_listing(spark, sf_dir):
    """Every file below sf_dir, with its metadata."""
    return tree.entries(spark, sf_dir, PLAN.skip_directories).select("entry", "rel_path", "name", "extension", "size", "is_regular", "stat_error")


QUERIES = (
    frontmatter_split, frontmatter_status_counts, extension_mime, skip_dir_prune, format_kept, format_skipped, index_stats, walk_order, relpath_containment,
    repo_name_valid, repo_list_json, properties_get, document_events, document_json, heading_chunks, chunk_embedding_input, chunk_vectors, index_outcomes, index_failures, properties_rich, embedding_topk,
    embedding_topk_filtered, incremental_changes, file_listing,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


_CHUNKS_SQL = f"""
    WITH {NOTES_SQL},
    lines AS (
        SELECT doc_id, lines_before, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS total
        FROM (SELECT doc_id, lines_before, CASE WHEN string_split(body, chr(10))[-1] = '' THEN string_split(body, chr(10))[:-2] ELSE string_split(body, chr(10)) END AS l FROM split WHERE body IS NOT NULL)),
    fenced AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER w % 2 AS inside FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    leveled AS (SELECT *, CASE WHEN NOT fence AND inside = 0 AND regexp_matches(line, '^#{{1,6}} ') THEN length(regexp_extract(line, '^(#{{1,6}}) ', 1)) END AS lvl FROM fenced),
    grouped AS (
        SELECT *, count(lvl) OVER w AS g, {", ".join(f"max(CASE WHEN lvl = {k} THEN n END) OVER w AS l{k}" for k in range(1, 7))}
        FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    heads AS (
        SELECT doc_id, g, unnest([{", ".join(f"CASE WHEN {' AND '.join([f'l{k} IS NOT NULL', *[f'l{k} > coalesce(l{j}, 0)' for j in range(1, k)]])} THEN l{k} END" for k in range(1, 7))}]) AS pos
        FROM grouped WHERE lvl IS NOT NULL),
    titles AS (
        SELECT h.doc_id, h.g, string_agg(trim(substr(r.line, r.lvl + 1)), ' > ' ORDER BY h.pos) AS heading_path
        FROM heads h JOIN leveled r ON h.doc_id = r.doc_id AND h.pos = r.n GROUP BY ALL),
    texts AS (
        SELECT doc_id, g, lines_before + min(n) AS start_line, lines_before + max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS text
        FROM grouped GROUP BY doc_id, g, lines_before),
    chunks AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chunk_no, coalesce(heading_path, '') AS heading_path, start_line, end_line, text
        FROM texts LEFT JOIN titles USING (doc_id, g) WHERE g > 0 OR regexp_matches(text, '\\S'))"""

_TOPK_SQL = """
    SELECT query_id, neighbor_id, similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS rank FROM (
            SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS similarity
            FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id {where}))
    WHERE rank <= {k}"""

_OUTCOMES_SQL = """
    outcomes AS (
        SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN '../' ELSE '' END || rel_path AS rel_path,
               CASE WHEN doc_id % 13 = 0 THEN 'no such file' WHEN doc_id % 19 = 0 THEN 'not a regular file' WHEN doc_id % 23 = 0 THEN 'file not under repo path' WHEN doc_id % 17 = 0 THEN 'unreadable' END AS error
        FROM typed WHERE NOT below AND extension = '.md')"""

_NAMES_SQL = ", ".join(f"('{n}')" for n in NAMES)


def oracle_sql() -> dict[str, str]:
    mime = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.MIME_TYPES.items())
    return {
        "frontmatter_split": f"WITH {NOTES_SQL} SELECT doc_id, status, front_matter, md5(body) AS body_md5, CAST(lines_before AS BIGINT) AS lines_before FROM split",
        "frontmatter_status_counts": f"WITH {NOTES_SQL} SELECT status, count(*) AS notes FROM split GROUP BY status",
        "extension_mime": f"WITH {PLACED_SQL} SELECT doc_id, rel_path, extension, CASE extension {mime} ELSE '{paths.DEFAULT_MIME_TYPE}' END AS mime_type FROM typed",
        "skip_dir_prune": f"WITH {PLACED_SQL} SELECT doc_id, rel_path, below AS skipped, CASE WHEN below THEN regexp_extract(rel_path, '^((?:[^/]*/)*?\\.obsidian)/', 1) END AS skipped_dir FROM typed",
        "format_kept": f"WITH {PLACED_SQL} SELECT doc_id, rel_path, extension FROM typed t WHERE NOT below AND EXISTS (SELECT 1 FROM (VALUES ('.md')) f(e) WHERE f.e = t.extension)",
        "format_skipped": f"WITH {PLACED_SQL} SELECT doc_id, rel_path, extension FROM typed t WHERE NOT below AND NOT EXISTS (SELECT 1 FROM (VALUES ('.md')) f(e) WHERE f.e = t.extension)",
        "index_stats": f"""WITH {PLACED_SQL} SELECT count(DISTINCT CASE WHEN below THEN regexp_extract(rel_path, '^((?:[^/]*/)*?\\.obsidian)/', 1) END) AS dirs_skipped,
            count(*) FILTER (NOT below AND extension <> '.md') AS docs_skipped, count(*) FILTER (NOT below AND extension = '.md') AS docs_prepared, CAST(0 AS BIGINT) AS docs_failed FROM typed""",
        "walk_order": f"WITH {PLACED_SQL} SELECT doc_id, rel_path, row_number() OVER (ORDER BY string_split(rel_path, '/')) - 1 AS position FROM placed",
        "relpath_containment": f"""WITH {PLACED_SQL},
            full_path AS (SELECT doc_id, (['/vault/', '/vault/', '/other/', '/vaulted/', '/vault/'])[doc_id % 5 + 1] || rel_path AS path FROM placed)
            SELECT doc_id, path, CASE WHEN starts_with(path, '/vault/') THEN substr(path, 8) ELSE '..' || path END AS relative, starts_with(path, '/vault/') AS local FROM full_path""",
        "repo_name_valid": f"""SELECT DISTINCT name, name NOT IN ('', '.', '..') AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AS valid
            FROM (SELECT * FROM (VALUES {_NAMES_SQL}) v(name) UNION ALL SELECT source || '/' || lang FROM documents UNION ALL SELECT source FROM documents)""",
        "repo_list_json": """SELECT '[' || coalesce(string_agg('{"application":"obsidian","name":"' || n || '","directory":"/vaults/' || n || '","config":"/c/repos/' || n || '/config.yaml","db":"/c/repos/' || n || '/vellum.db"}', ',' ORDER BY n), '') || ']' AS repos
            FROM (SELECT DISTINCT source AS n FROM documents)""",
        "properties_get": f"""WITH {NOTES_SQL} SELECT doc_id, {", ".join(f"CASE WHEN status = 'ok' AND front_matter <> '' THEN {cast} END AS note_{k}" for k, cast in (("title", "regexp_extract(front_matter, '(?m)^title: (.*)$', 1)"), ("status", "regexp_extract(front_matter, '(?m)^status: (.*)$', 1)"), ("source", "regexp_extract(front_matter, '(?m)^source: (.*)$', 1)"), ("rating", "CAST(regexp_extract(front_matter, '(?m)^rating: (.*)$', 1) AS BIGINT)")))},
            status = 'unterminated' AS failed FROM split""",
        "document_events": f"""WITH {NOTES_SQL}, {PLACED_SQL},
            kept AS (SELECT rel_path, status = 'unterminated' AS bad FROM typed JOIN split USING (doc_id) WHERE NOT below AND extension = '.md')
            SELECT DISTINCT regexp_extract(rel_path, '^((?:[^/]*/)*?\\.obsidian)/', 1) AS rel_path, CAST(0 AS BIGINT) AS step, 'dir-skipped' AS kind, CAST(NULL AS VARCHAR) AS error, true AS delivered FROM typed WHERE below
            UNION ALL SELECT rel_path, 0, 'file-skipped', NULL, true FROM typed WHERE NOT below AND extension <> '.md'
            UNION ALL SELECT rel_path, 0, 'file-indexing', NULL, false FROM kept
            UNION ALL SELECT rel_path, 1, 'file-parsing', NULL, false FROM kept
            UNION ALL SELECT rel_path, 2, 'file-parsed', NULL, false FROM kept WHERE NOT bad
            UNION ALL SELECT rel_path, CASE WHEN bad THEN 2 ELSE 3 END, 'file-indexed', NULL, false FROM kept""",
        "document_json": f"""WITH {NOTES_SQL}, {PLACED_SQL}
            SELECT doc_id, '{{"appType":"obsidian","chunks":null,"extension":"' || extension || '","name":"' || regexp_extract(rel_path, '([^/]*)$', 1) || '","properties":' ||
                CASE WHEN status = 'ok' AND front_matter <> '' THEN '{{"rating":' || regexp_extract(front_matter, '(?m)^rating: (.*)$', 1) || ',"source":"' || regexp_extract(front_matter, '(?m)^source: (.*)$', 1) ||
                    '","status":"' || regexp_extract(front_matter, '(?m)^status: (.*)$', 1) || '","title":"' || regexp_extract(front_matter, '(?m)^title: (.*)$', 1) || '"}}' ELSE 'null' END || ',"relPath":"' || rel_path || '"}}' AS json
            FROM typed JOIN split USING (doc_id)""",
        "heading_chunks": _CHUNKS_SQL + " SELECT doc_id, chunk_no, heading_path, start_line, end_line, md5(text) AS text_md5 FROM chunks",
        "chunk_embedding_input": _CHUNKS_SQL + """, inputs AS (SELECT doc_id, chunk_no, CASE WHEN heading_path <> '' THEN heading_path || chr(10) || text ELSE text END AS input FROM chunks)
            SELECT doc_id, chunk_no, length(input) AS n_chars, md5(input) AS input_md5 FROM inputs""",
        "chunk_vectors": _CHUNKS_SQL + """, inputs AS (SELECT doc_id, chunk_no, CASE WHEN heading_path <> '' THEN heading_path || chr(10) || text ELSE text END AS input FROM chunks),
            words AS (SELECT doc_id, chunk_no, unnest(list_filter(regexp_split_to_array(translate(input, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS w FROM inputs),
            hashed AS (SELECT doc_id, chunk_no, CAST('0x' || substr(md5(w), 7, 2) AS BIGINT) AS place, 1 - 2 * (CAST('0x' || substr(md5(w), 9, 2) AS BIGINT) % 2) AS sign FROM words),
            entries AS (SELECT doc_id, chunk_no, place, CAST(sum(sign) AS DOUBLE) AS v FROM hashed GROUP BY ALL)
            SELECT doc_id, chunk_no, place, round(CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, chunk_no)) AS FLOAT) AS DOUBLE), 4) AS value FROM entries QUALIFY v <> 0""",
        "index_outcomes": f"WITH {NOTES_SQL}, {PLACED_SQL}, {_OUTCOMES_SQL} SELECT doc_id, rel_path, error, CASE WHEN error IS NULL AND status = 'unterminated' THEN 'unterminated front matter' END AS parse_error FROM outcomes JOIN split USING (doc_id)",
        "index_failures": f"""WITH {PLACED_SQL}, {_OUTCOMES_SQL} SELECT CAST(0 AS BIGINT) AS dirs_skipped, (SELECT count(*) FROM typed WHERE NOT below AND extension <> '.md') AS docs_skipped,
            (SELECT count(*) FROM outcomes WHERE error IS NULL) AS docs_prepared, (SELECT count(*) FROM outcomes WHERE error IS NOT NULL) AS docs_failed""",
        "properties_rich": """SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN '{"nested":{"deep":{"k":null,"z":true},"on":"yes"},"quoted":"7","ratio":' || (doc_id % 10) || '.5,"size":' || doc_id || ',"tags":["a' || doc_id
            || '","b c"],"when":"2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z"}' END AS properties_json, doc_id % 9 = 0 AS failed FROM documents""",
        "embedding_topk": _TOPK_SQL.format(where="", k=10),
        "embedding_topk_filtered": _TOPK_SQL.format(where="AND r.label % 2 = 0", k=5),
        "incremental_changes": f"""WITH {PLACED_SQL} SELECT rel_path AS path, CASE doc_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'modified' WHEN 3 THEN 'removed' ELSE 'same' END AS change FROM placed""",
    }
