"""Queries of the general data-processing problems (p1 to p3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import drift, incremental, shred
from quire.runtime import materialize, shared_dir, table


def p1_found(spark, sf_dir):
    return incremental.replay(table(spark, sf_dir, "entry_feed"), table(spark, sf_dir, "load_runs"))


def p1_run_sizes(spark, sf_dir):
    """Files, records and bytes each succeeded run had to process; runs without work are kept."""
    feed, runs = table(spark, sf_dir, "entry_feed"), table(spark, sf_dir, "load_runs").where("status = 'succeeded'")
    work = incremental.replay(feed, runs).join(feed.select("feed_id", "n_bytes"), "feed_id").groupBy("run_id").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    return runs.select("run_id", "library_id").join(work, "run_id", "left").select("run_id", "library_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def p1_manifest(spark, sf_dir):
    """What three batches over the whole feed process, each at a further third of its time, run one after
    another through the manifest store."""
    feed = table(spark, sf_dir, "entry_feed").where("content_hash is not null")
    file = F.coalesce(F.concat(F.lit("p"), incremental.posix_location(F.col("path"))), F.concat(F.lit("h"), F.col("content_hash").cast("string")))
    rows = feed.select(F.concat_ws("/", F.col("library_id").cast("string"), file).alias("path"), "arrived_at", F.struct(F.coalesce("modified_at", "arrived_at"), "feed_id", F.col("n_bytes").alias("size"), F.col("content_hash").cast("string").alias("checksum")).alias("v"))
    low, high = feed.agg(F.unix_micros(F.min("arrived_at").cast("timestamp")), F.unix_micros(F.max("arrived_at").cast("timestamp"))).first()
    store = incremental.ManifestStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for batch in (1, 2, 3):
        until = low + (high - low) * batch // 3 if low is not None else 0
        listing = rows.where(F.unix_micros(F.col("arrived_at").cast("timestamp")) <= until).groupBy("path").agg(F.max("v").alias("v")).select("path", "v.size", "v.checksum")
        store.run(listing, str(batch), lambda new: new)
    return store.data().select(F.col("batch_id").cast("int").alias("batch_id"), "path", "size", "checksum")


def p2_found(spark, sf_dir):
    return shred.objects(table(spark, sf_dir, "frontmatters"), "fm_id", "root")


def p2_revisions(spark, sf_dir):
    """The entity table of extra.revisions, each row naming its parent."""
    nodes = materialize(shred.shred(table(spark, sf_dir, "frontmatters"), "fm_id", "root"), "shred")
    return shred.entity_table(nodes, "fm_id", "$.extra.revisions[]", ["date", "note", "version"])


def p2_entities(spark, sf_dir):
    """Rows, parents and scalar children per entity table."""
    nodes = materialize(shred.shred(table(spark, sf_dir, "frontmatters"), "fm_id", "root"), "shred")
    return shred.entities(nodes, "fm_id").groupBy("entity").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("parent_path").isNotNull()).alias("n_linked"), F.sum(F.coalesce(F.size("scalars"), F.lit(0)).cast("bigint")).alias("n_scalars")
    )


def p2_scalars(spark, sf_dir):
    """Every scalar of every entity table, with its row and label."""
    nodes = materialize(shred.shred(table(spark, sf_dir, "frontmatters"), "fm_id", "root"), "shred")
    return shred.entities(nodes, "fm_id").select("fm_id", "node_path", "parent_path", F.explode("scalars").alias("label", "scalar"))


def p3_found(spark, sf_dir):
    return drift.change_log(table(spark, sf_dir, "frontmatters")).select("library_id", "export_no", "change", "old_field", "new_field")


def p3_log(spark, sf_dir):
    """The ordered log of all changes, with the promoted types before and after."""
    return drift.change_log(table(spark, sf_dir, "frontmatters"))


def p3_schema(spark, sf_dir):
    """The union schema: every field with its promoted type."""
    return drift.union_schema(drift.observe(table(spark, sf_dir, "frontmatters"), ["fm_id"], "root")).select("field", "spark_type", "records")


def p3_unified(spark, sf_dir):
    """One consistent table over all exports, read from the raw source where the exported root is broken."""
    return drift.unify(table(spark, sf_dir, "frontmatters"), ["library_id", "export_no", "fm_id"], raw=("frontmatter", "fm_format"))


def p3_profile(spark, sf_dir):
    """Of the unified table of all readable roots: type, records and values of every column, and the sum of
    whole numbers."""
    wide = drift.unify(table(spark, sf_dir, "frontmatters"), ["fm_id"])
    kinds = dict(wide.dtypes)
    rows = []
    for name in wide.columns[1:]:
        c, kind = F.col(f"`{name}`"), kinds[name]
        items = F.filter(c, lambda x: x.isNotNull()) if kind.startswith("array") else F.when(c.isNotNull(), F.array(c))
        total = F.aggregate(items, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + x).cast("decimal(38,0)")) if "bigint" in kind else F.lit(None).cast("decimal(38,0)")
        rows.append(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("data_type"), F.size(items).alias("n"), total.alias("total")))
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0")
    return long.groupBy("field", "data_type").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_values"), F.sum("total").cast("bigint").alias("total"))


QUERIES = {f.__name__: f for f in (p1_found, p1_run_sizes, p1_manifest, p2_found, p2_revisions, p2_entities, p2_scalars, p3_found, p3_log, p3_schema, p3_unified, p3_profile)}

_P1_FILE = """
  SELECT library_id, feed_id, content_hash, arrived_at, coalesce(modified_at, arrived_at) AS changed,
         CASE WHEN path IS NULL THEN 'h' || content_hash ELSE 'p' || array_to_string(list_reduce(
             list_prepend([]::VARCHAR[], list_transform(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')), lambda s: [s])),
             lambda acc, s: CASE WHEN s[1] <> '..' OR len(acc) = 0 OR acc[-1] = '..' THEN list_concat(acc, s) ELSE acc[1:-2] END), '/') END AS file
  FROM entry_feed WHERE content_hash IS NOT NULL"""

_P1 = f"""
WITH rows AS ({_P1_FILE}),
runs AS (SELECT run_id, library_id, cutoff_at, lag(cutoff_at) OVER (PARTITION BY library_id ORDER BY cutoff_at, run_id) AS before
         FROM load_runs WHERE status = 'succeeded'),
state AS (SELECT q.run_id, r.file, arg_max(r.feed_id, (r.changed, r.feed_id)) AS feed_id, arg_max(r.content_hash, (r.changed, r.feed_id)) AS hash,
                 arg_max(r.content_hash, (r.changed, r.feed_id)) FILTER (WHERE r.arrived_at <= q.before) AS old_hash
          FROM runs q JOIN rows r ON r.library_id = q.library_id AND r.arrived_at <= q.cutoff_at GROUP BY ALL),
found AS (SELECT run_id, feed_id FROM state WHERE old_hash IS DISTINCT FROM hash)
"""

_NODES = r"""
WITH RECURSIVE readable AS (
  SELECT fm_id, root FROM (
    SELECT fm_id, CASE WHEN json_valid(root) AND json_type(root) = 'VARCHAR' THEN json_extract_string(root, '$') ELSE root END AS root FROM frontmatters)
  WHERE json_valid(root) AND json_type(root) = 'OBJECT'),
nodes AS (
  SELECT fm_id, root::JSON AS value, 'OBJECT' AS kind, '$' AS path, NULL::VARCHAR AS parent_path, '$' AS entity, NULL::VARCHAR AS label FROM readable
  UNION ALL
  SELECT n.fm_id, c.value, c.type, n.path || CASE WHEN n.kind = 'OBJECT' THEN '.' || c.key ELSE '[' || c.key || ']' END,
         CASE WHEN n.kind = 'OBJECT' THEN n.path ELSE n.parent_path END,
         n.entity || CASE WHEN n.kind = 'OBJECT' THEN '.' || c.key ELSE '[]' END, CASE WHEN n.kind = 'OBJECT' THEN c.key END
  FROM nodes n, json_each(n.value) c WHERE n.kind IN ('OBJECT', 'ARRAY'))
"""

ORACLE = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_run_sizes": _P1
    + """SELECT q.run_id, q.library_id, count(f.feed_id) AS n_files, coalesce(sum(e.n_bytes), 0)::BIGINT AS n_bytes
  FROM runs q LEFT JOIN found f USING (run_id) LEFT JOIN entry_feed e USING (feed_id) GROUP BY ALL""",
    "p1_manifest": f"""
WITH rows AS ({_P1_FILE.replace("SELECT library_id", "SELECT n_bytes, library_id")}),
ends AS (SELECT b AS batch_id, make_timestamp(epoch_us(min(arrived_at)) + (epoch_us(max(arrived_at)) - epoch_us(min(arrived_at))) * b // 3) AS until FROM rows, range(1, 4) t(b) GROUP BY b),
state AS (SELECT batch_id::INT AS batch_id, library_id || '/' || file AS path, arg_max(n_bytes, (changed, feed_id)) AS size, arg_max(content_hash, (changed, feed_id))::VARCHAR AS checksum
          FROM rows JOIN ends ON arrived_at <= until GROUP BY ALL)
SELECT * FROM state s WHERE NOT EXISTS (SELECT 1 FROM state b WHERE b.batch_id = s.batch_id - 1 AND b.path = s.path AND b.size = s.size AND b.checksum = s.checksum)""",
    "p2_found": _NODES + "SELECT fm_id, path AS node_path, parent_path FROM nodes WHERE kind = 'OBJECT' AND path <> '$'",
    "p2_entities": _NODES
    + """SELECT o.entity, count(*) AS n_rows, count(o.parent_path) AS n_linked, coalesce(sum(c.n), 0)::BIGINT AS n_scalars
  FROM nodes o LEFT JOIN (SELECT fm_id, parent_path AS path, count(*) AS n FROM nodes WHERE kind NOT IN ('OBJECT', 'ARRAY') AND label IS NOT NULL GROUP BY ALL) c USING (fm_id, path)
  WHERE o.kind = 'OBJECT' GROUP BY o.entity""",
    "p2_scalars": _NODES
    + """SELECT o.fm_id, o.path AS node_path, o.parent_path, c.label, CASE WHEN c.kind = 'VARCHAR' THEN json_extract_string(c.value, '$') WHEN c.kind <> 'NULL' THEN c.value::VARCHAR END AS scalar
  FROM nodes o JOIN nodes c ON c.fm_id = o.fm_id AND c.parent_path = o.path WHERE o.kind = 'OBJECT' AND c.kind NOT IN ('OBJECT', 'ARRAY') AND c.label IS NOT NULL""",
    "p2_revisions": _NODES
    + """SELECT o.fm_id, o.path AS node_path, o.parent_path, regexp_extract(o.path, '\\[(\\d+)\\]$', 1)::INT AS ordinal,
  json_extract_string(o.value, '$.date') AS "date", json_extract_string(o.value, '$.note') AS note, json_extract_string(o.value, '$.version') AS version
  FROM nodes o WHERE o.kind = 'OBJECT' AND o.entity = '$.extra.revisions[]'""",
}

_FIELDS = r"""
WITH RECURSIVE readable AS (
  SELECT * FROM (
    SELECT fm_id, library_id, export_no, exported_at, path AS file,
           CASE WHEN json_valid(root) AND json_type(root) = 'VARCHAR' THEN json_extract_string(root, '$') ELSE root END AS root FROM frontmatters)
  WHERE json_valid(root) AND json_type(root) = 'OBJECT'),
nodes AS (
  SELECT fm_id, root::JSON AS value, 'OBJECT' AS kind, '' AS field, '' AS place, true AS named FROM readable
  UNION ALL
  SELECT n.fm_id, c.value, c.type, CASE WHEN n.kind = 'ARRAY' THEN n.field || '[]' WHEN n.field = '' THEN c.key ELSE n.field || '.' || c.key END,
         n.place || CASE WHEN n.kind = 'ARRAY' THEN printf('/%09d', c.key::INT) ELSE '' END, n.kind = 'OBJECT'
  FROM nodes n, json_each(n.value) c WHERE n.kind IN ('OBJECT', 'ARRAY')),
held AS (
  SELECT r.library_id, r.export_no, r.exported_at, r.fm_id, r.file, n.field,
         list(DISTINCT CASE n.kind WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' ELSE 'integer' END) AS types,
         list(CASE WHEN n.kind = 'VARCHAR' THEN json_extract_string(n.value, '$') ELSE n.value::VARCHAR END ORDER BY n.place) AS vals
  FROM nodes n JOIN readable r USING (fm_id) WHERE n.named AND n.kind NOT IN ('OBJECT', 'NULL') GROUP BY ALL)
"""

ORACLE["p3_schema"] = (
    _FIELDS
    + """SELECT field, CASE t WHEN ['integer'] THEN 'bigint' WHEN ['float'] THEN 'double' WHEN ['float', 'integer'] THEN 'double' WHEN ['boolean'] THEN 'boolean' ELSE 'string' END AS spark_type, records
  FROM (SELECT field, list_sort(list_distinct(flatten(list(types)))) AS t, count(DISTINCT fm_id) AS records FROM held GROUP BY field)"""
)
_CHANGES = (
    _FIELDS
    + """,
exports AS (SELECT DISTINCT library_id, export_no FROM readable),
pairs AS (SELECT * FROM exports e WHERE EXISTS (SELECT 1 FROM exports b WHERE b.library_id = e.library_id AND b.export_no = e.export_no - 1)),
seen AS (SELECT library_id, export_no, field, list_sort(list_distinct(flatten(list(types)))) AS types FROM held GROUP BY ALL),
diff AS (
  SELECT p.library_id, p.export_no, coalesce(a.field, b.field) AS field, a.types AS types_now, b.types AS types_before
  FROM pairs p, LATERAL (SELECT DISTINCT field AS f FROM seen s WHERE s.library_id = p.library_id AND s.export_no IN (p.export_no, p.export_no - 1)) x
  LEFT JOIN seen a ON a.library_id = p.library_id AND a.export_no = p.export_no AND a.field = x.f
  LEFT JOIN seen b ON b.library_id = p.library_id AND b.export_no = p.export_no - 1 AND b.field = x.f
  WHERE a.types IS DISTINCT FROM b.types),
latest AS (SELECT library_id, export_no, file, field, arg_max(vals, (exported_at, fm_id)) AS vals FROM held WHERE file IS NOT NULL GROUP BY ALL),
renamed AS (
  SELECT g.library_id, g.export_no, g.field AS old_field, n.field AS new_field
  FROM diff g JOIN diff n ON n.library_id = g.library_id AND n.export_no = g.export_no AND g.types_now IS NULL AND n.types_before IS NULL
  JOIN latest o ON o.library_id = g.library_id AND o.export_no = g.export_no - 1 AND o.field = g.field
  JOIN latest c ON c.library_id = g.library_id AND c.export_no = g.export_no AND c.field = n.field AND c.file = o.file
  GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (WHERE o.vals = c.vals) >= 0.8 * count(*)),
found AS (
SELECT library_id, export_no, 'renamed' AS change, old_field, new_field FROM renamed
UNION ALL SELECT library_id, export_no, 'removed', field, '' FROM diff d WHERE types_now IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.library_id = d.library_id AND r.export_no = d.export_no AND r.old_field = d.field)
UNION ALL SELECT library_id, export_no, 'added', '', field FROM diff d WHERE types_before IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.library_id = d.library_id AND r.export_no = d.export_no AND r.new_field = d.field)
UNION ALL SELECT library_id, export_no, 'retyped', field, field FROM diff WHERE types_now IS NOT NULL AND types_before IS NOT NULL)"""
)
_TYPE = "CASE t WHEN ['integer'] THEN 'bigint' WHEN ['float'] THEN 'double' WHEN ['float', 'integer'] THEN 'double' WHEN ['boolean'] THEN 'boolean' ELSE 'string' END"
ORACLE["p3_found"] = _CHANGES + " SELECT * FROM found"
ORACLE["p3_log"] = (
    _CHANGES
    + f""", typed AS (SELECT library_id, export_no, field, {_TYPE} AS name FROM (SELECT *, types AS t FROM seen))
SELECT f.*, o.name AS old_type, n.name AS new_type, row_number() OVER (PARTITION BY f.library_id, f.export_no ORDER BY change, encode(old_field), encode(new_field))::INT AS change_no FROM found f
LEFT JOIN typed o ON o.library_id = f.library_id AND o.export_no = f.export_no - 1 AND o.field = f.old_field LEFT JOIN typed n ON n.library_id = f.library_id AND n.export_no = f.export_no AND n.field = f.new_field"""
)
ORACLE["p3_profile"] = (
    _FIELDS
    + f"""SELECT field, CASE WHEN many THEN 'array<' || kind || '>' ELSE kind END AS data_type, n_records, n_values, CASE WHEN kind = 'bigint' THEN total END::BIGINT AS total FROM (
 SELECT *, {_TYPE} AS kind FROM (
  SELECT field, list_sort(list_distinct(flatten(list(types)))) AS t, count(*)::BIGINT AS n_records, sum(len(vals))::BIGINT AS n_values, field LIKE '%[]%' OR max(len(vals)) > 1 AS many,
         sum(list_sum(list_transform(vals, lambda v: try_cast(v AS HUGEINT)))) AS total FROM held GROUP BY field))"""
)
