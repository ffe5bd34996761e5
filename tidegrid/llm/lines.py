"""Removal of repeated passages of lines, in DataFrame and SQL functions only.

A document is cut into chunks of whole lines where the rolling hash of the line hashes has a local minimum, so
that a line put in or left out moves the cuts next to it only, and every inner chunk has two lines at
least. Of chunks of several lines that occur more than once anywhere, the first stays; the others go, after
their bytes have been compared with those of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, numbered, saved, small, table

LAST = (1 << 63) - 1
MARK = "[^\\x09-\\x0D\\x20]"


def chunks(lines: str) -> Column:
    """Chunks of an array of lines as (lo, n, h): first line, lines, hash of the text.

    With h_i the hash of line i and r_i that of (h_i-1, h_i), line i > 1 begins a chunk if r_i < r_i-1 and
    r_i <= r_i+1.
    """
    rolled = "transform(_h, (h, i) -> CASE WHEN i = 0 THEN '' ELSE md5(concat(get(_h, i - 1), h)) END)"
    starts = "concat(array(0), filter(CASE WHEN size(_r) > 3 THEN sequence(2, size(_r) - 2) ELSE CAST(array() AS array<int>) END, i -> get(_r, i) < get(_r, i - 1) AND get(_r, i) <= get(_r, i + 1)))"
    spans = f"transform(_s, (lo, k) -> struct(lo AS lo, coalesce(get(_s, k + 1), size({lines})) - lo AS n))"
    full = f"transform(_c, c -> struct(c.lo AS lo, c.n AS n, CASE WHEN c.n > 1 THEN unhex(md5(array_join(slice({lines}, c.lo + 1, c.n), '\n'))) END AS h))"
    step = lambda name, value, rest: f"element_at(transform(array({value}), {name} -> {rest}), 1)"
    return F.expr(step("_h", f"transform({lines}, l -> md5(l))", step("_r", rolled, step("_s", starts, step("_c", spans, full)))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with text less its repeated chunks, and n_lines, n_removed (both long).

    The first of equal chunks stays: the earliest in the row of the smallest doc_id, rows without one coming last and rows
    that share one in the order of their texts' MD5; of rows alike in both, one counts as the first. Chunks of one line, or
    without anything but white space, stay. Null text stays null with 0 lines; empty text is one empty line. An empty table
    gives an empty result. Other columns pass through; n_lines and n_removed replace columns of that name.

    Chunks travel as hashes; texts are moved once, and only the chunks whose hash occurs again are read out of them.
    """
    docs, back = aside(docs.drop("n_lines", "n_removed"), "doc_id", "text")
    columns = docs.columns
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    base = docs.select(*columns).withColumns({"_did": did, "_th": F.coalesce(F.unhex(F.md5("text")), F.lit(bytearray()))})
    each = base.where("text IS NOT NULL").select("_did", "_th", F.split("text", "\n").alias("lines"))
    each = each.where("size(lines) > 1").select("_did", "_th", F.explode(chunks("lines")).alias("c"))
    each = saved(each.select("_did", "_th", "c.*").where("n > 1"))
    seen = each.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_did", "_th", "lo")).alias("d0")).where("times > 1").drop("times")
    # written, so that Spark may split the other side of its join by size: a chunk may be in a third of all rows
    seen = saved(seen)
    first = (F.col("_did") == F.col("d0._did")) & (F.col("_th") == F.col("d0._th")) & (F.col("lo") == F.col("d0.lo"))
    some = each.join(small(seen, seen.count()), "h").withColumn("first", first).groupBy("_did", "_th")
    some = some.agg(F.collect_set(F.struct("lo", "n", "h", "first")).alias("found"), F.count(F.lit(1)).alias("alike"))
    alike = (F.col("alike") / F.size("found")).cast("long").alias("alike")
    some = saved(some.select(F.col("_did").alias("_d"), F.col("_th").alias("_t"), "found", alike))
    # Both joins of the texts read all columns, so that Spark moves the texts once and reads that exchange twice.
    same = (F.col("_did") == F.col("_d")) & (F.col("_th") == F.col("_t"))
    found = base.join(some, same & (F.hash("found", *columns) >= -(1 << 31)))
    # the chunks alone leave a text, whose lines are cut once
    read = "element_at(transform(array(split(text, '\n')), _l -> transform(found, f -> struct(f.lo, f.n, f.h, f.first, array_join(slice(_l, f.lo + 1, f.n), '\n') AS chunk))), 1)"
    found = found.select("_did", "_th", "alike", F.explode(F.expr(read)).alias("f")).select("_did", "_th", "alike", "f.*").where(F.col("chunk").rlike(MARK))
    # told apart by more than the join's keys, so that the join moves both sides itself and Spark can split them by size
    kept = found.where("first").select("h", F.col("chunk").alias("same"), F.hash("h").alias("_z")).distinct().drop("_z")
    gone = found.where("NOT first OR alike > 1").join(kept, "h").where("chunk = same")
    gone = gone.groupBy("_did", "_th").agg(F.collect_set(F.struct("lo", "n", "first")).alias("_gone"))
    gone = gone.select(F.col("_did").alias("_d"), F.col("_th").alias("_t"), "_gone")
    if some.where("alike > 1").limit(1).count():  # of rows alike in doc_id and text, the one numbered 1 keeps what occurs here first
        twins = some.where("alike > 1").select("_d", "_t")
        rows = base.join(twins, same, "left_anti").join(gone, same, "left")
        more = numbered(base.join(twins, same).drop("_d", "_t"), ["_did", "_th"]).join(gone, same, "left")
        left = F.when(F.col("_nth") == 1, F.filter("_gone", lambda g: ~g["first"])).otherwise(F.col("_gone"))
        rows = rows.unionByName(more.withColumn("_gone", left).drop("_nth"))
    else:
        rows = base.join(gone, same, "left")
    rows = rows.withColumn("_gone", F.when(F.size("_gone") > 0, F.sort_array("_gone"))).withColumn("_lines", F.split("text", "\n"))
    # the lines between the chunks that go
    begin, end = "coalesce(get(_gone, k - 1).lo + get(_gone, k - 1).n, 0)", "coalesce(get(_gone, k).lo, size(_lines))"
    rest = F.expr(f"array_join(flatten(transform(sequence(0, size(_gone)), k -> slice(_lines, {begin} + 1, {end} - {begin}))), '\n')")
    removed = F.coalesce(F.expr("aggregate(_gone, 0L, (s, g) -> s + g.n)"), F.lit(0)).cast("long")
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest).alias("text")
    return rows.select(*(left if c == "text" else own for c, own in back.items()), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what deduplicated() leaves of their text; those of which nothing is left go."""
    left = deduplicated(docs.drop("n_chars")).where((F.col("n_removed") == 0) | F.col("text").rlike(MARK))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS did, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT did, text, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM (SELECT DISTINCT did, text, lines FROM d WHERE text IS NOT NULL)),
h AS (SELECT *, CASE WHEN i = 0 THEN '' ELSE md5(concat(md5(lag(line) OVER w), md5(line))) END AS r FROM l WINDOW w AS (PARTITION BY did, text ORDER BY i)),
b AS (SELECT *, (i = 0 OR (i BETWEEN 2 AND n - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w)) AS cut FROM h WINDOW w AS (PARTITION BY did, text ORDER BY i)),
k AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY did, text ORDER BY i) AS part FROM b),
c AS (SELECT did, text, part, min(i) AS lo, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY ALL),
a AS (SELECT did, text, unnest(range(count(*))) AS twin FROM d WHERE text IS NOT NULL GROUP BY did, text),
m AS (SELECT c.*, twin, row_number() OVER (PARTITION BY chunk ORDER BY c.did, md5(c.text), twin, lo) AS nth
      FROM c JOIN a ON c.did = a.did AND c.text = a.text WHERE n > 1 AND regexp_matches(chunk, '[^\x09-\x0D\x20]')),
g AS (SELECT did, text, twin, lo, n FROM m WHERE nth > 1),
x AS (SELECT l.did, l.text, a.twin, count(g.lo) AS n_removed, string_agg(CASE WHEN g.lo IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS kept
      FROM l JOIN a ON l.did = a.did AND l.text = a.text LEFT JOIN g ON l.did = g.did AND l.text = g.text AND g.twin = a.twin AND l.i >= g.lo AND l.i < g.lo + g.n GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY did, text) - 1 AS twin FROM d)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN coalesce(x.n_removed, 0) = 0 THEN d.text ELSE coalesce(x.kept, '') END AS text
FROM e d LEFT JOIN x ON d.did = x.did AND d.text = x.text AND d.twin = x.twin
"""
