"""Line dedup over overlapping three-line windows (native DataFrame functions only).

Lines are the text between ``\\n``.  Every run of ``window`` consecutive lines
is hashed (two independent 64-bit hashes); of each window content the first
occurrence in (id, row, position) order stays, and every line covered by a
later occurrence is removed, overlapping windows being merged.  Each removed
line therefore has an equal line earlier in the corpus, and the earliest copy
of every line survives.

Defined cases: null text stays null (0 lines); an empty text is one empty
line; texts of fewer than ``window`` lines are left alone; a text whose lines
all go becomes empty, its row stays; null ids come first; rows repeated with
the same id are told apart by their place in the table; input columns named
like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from txsentry.llm.common import col, fresh, written


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3,
                row: list[str] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the text deduplicated, plus
    ``n_lines`` (before) and ``n_removed``.

    ``row``: columns that tell the rows apart and are the same at every read
    of ``docs``; without them the rows are written with numbers.
    """
    at_row, wins, ha, hb = fresh([*docs.columns, "n_lines", "n_removed"], "_row", "_wins", "_ha", "_hb")
    lines = F.split(col(text_col), "\n", -1)

    # Hashes are columns of their own: inside a lambda an expression would be
    # evaluated anew for every element.
    named = docs.withColumn(at_row, F.struct(*[col(c) for c in row]) if row else F.monotonically_increasing_id())
    hashed = (named.withColumn(wins, lines)
              .withColumn(ha, F.transform(wins, lambda x: F.xxhash64(x)))
              .withColumn(hb, F.transform(wins, lambda x: F.xxhash64(F.lit(1), x))))
    at = F.when(F.size(ha) >= window, F.sequence(F.lit(0), F.size(ha) - window))
    windows = F.transform(at, lambda i: F.struct(
        F.xxhash64(*[F.get(F.col(ha), i + k) for k in range(window)]).alias("a"),
        F.xxhash64(*[F.get(F.col(hb), i + k) for k in range(window)]).alias("b")))
    hashed = hashed.withColumn(wins, windows).drop(ha, hb)
    if row:
        rows = named
        slim = written(hashed.select(col(id_col).alias("id"), F.col(at_row).alias("row"), F.col(wins).alias("wins")), "line-windows")
    else:
        # Row ids must not change between the two uses of the rows, so they are written.
        rows = written(hashed, "line-windows")
        slim = rows.select(col(id_col).alias("id"), F.col(at_row).alias("row"), F.col(wins).alias("wins"))

    occ = (slim.select("id", "row", F.posexplode("wins").alias("pos", "w"))
           .select("id", "row", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b")))
    first = (occ.groupBy("a", "b")
             .agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "pos")).alias("first"))
             .filter("n > 1").select("a", "b", F.col("first.row").alias("row0"), F.col("first.pos").alias("pos0")))
    later = occ.join(first, ["a", "b"]).filter("row != row0 OR pos != pos0").select("row", "pos")

    # Merge the covered runs: what lies between the end of one window and the
    # start of the next stays.
    per_row = Window.partitionBy("row").orderBy("pos")
    gaps = later.withColumn("from", F.coalesce(F.lag("pos").over(per_row) + window, F.lit(0)))
    cover = (gaps.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("from"), F.struct("from", "pos")))).alias("keep"),
        (F.max("pos") + window).alias("tail"),
        F.sum(F.greatest(F.col("pos") - F.col("from"), F.lit(0))).alias("stay"))
        .withColumnRenamed("row", at_row + "2"))

    keep, tail, stay, split = fresh(rows, "_keep", "_tail", "_stay", "_split")
    cover = cover.withColumnsRenamed({"keep": keep, "tail": tail, "stay": stay})
    n_lines = F.when(col(text_col).isNull(), F.lit(0)).otherwise(F.size(split))
    kept = F.concat(F.flatten(F.transform(F.col(keep), lambda s: F.slice(F.col(split), s["from"] + 1, s["pos"] - s["from"]))),
                    F.slice(F.col(split), F.col(tail) + 1, F.greatest(F.size(split) - F.col(tail), F.lit(0))))
    joined = rows.join(cover, F.col(at_row) == F.col(at_row + "2"), "left").withColumn(split, lines)
    gone = F.col(tail).isNotNull()
    return joined.select(
        *[(F.when(gone, F.array_join(kept, "\n")).otherwise(col(c)).alias(c) if c == text_col else col(c))
          for c in docs.columns if c.lower() not in ("n_lines", "n_removed")],
        n_lines.cast("long").alias("n_lines"),
        F.when(gone, F.col(tail) - F.col(stay)).otherwise(0).cast("long").alias("n_removed"))


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS p FROM l),
w AS (SELECT doc_id, p, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c
      FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k
      FROM w WHERE b IS NOT NULL AND c IS NOT NULL),
cov AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) t(o) WHERE k > 1),
kept AS (SELECT e.doc_id, count(*) AS n_lines, count(cov.p) AS n_removed,
                string_agg(CASE WHEN cov.p IS NULL THEN e.line END, chr(10) ORDER BY e.p) AS text
         FROM e LEFT JOIN cov ON e.doc_id = cov.doc_id AND e.p = cov.p GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
