"""Exact line deduplication over a whole corpus, with DataFrame functions only.

Line hashes are range-partitioned with a secondary sort by document and position; one streaming pass over each
sorted run finds the first occurrence and the number of documents, and the rows after it become the zeros of a
run-length compressed keep bitmap per document. Texts never travel with the hashes.

Skew: a bounded frequent-items sketch (``HOT_KEYS`` keys at most, whatever the size of the corpus) names the hashes
that could fill a sorted run. Their document count and first document come from a map-side combined aggregation and
are joined back by broadcast (at most ``HOT_KEYS`` rows), so no task ever gathers the rows of a hot line.

Defined results:
- null or empty text is one empty line; nothing is dropped from it;
- a null ``doc_id`` marks a row that takes no part: its lines are neither counted nor dropped;
- rows that share a ``doc_id`` count as one document; each row gets the bitmap of its own text;
- ties for "largest document" cannot arise, since ids of one document are equal;
- columns other than id and text are ignored by the bitmap and passed through by ``apply_bitmaps``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.keys import once
from millrace.session import materialise

#: Bytes stripped from both ends of a line before comparison.
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys named by the sketch at most, and counters it keeps: a key above 1/8000 of all lines is always among them.
HOT_KEYS, SKETCH = 8192, 32_768


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(STRIP))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, tid, pos) of every line whose key is long enough to count; 128 bits name a key."""
    # A text is hashed before it is cut, and does not travel with its lines.
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__doc"), _text_id(F.col(text_col)).alias("__tid"), F.col(text_col).alias("__text"))
    rows = texts.select("__doc", "__tid", F.posexplode(lines_of(F.col("__text"))).alias("__pos", "__line"))
    key = once(line_key(F.col("__line")))
    rows = rows.select("__doc", "__tid", "__pos", key.alias("__key")).filter(F.length("__key") >= min_chars)
    return rows.select(
        F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("line"), "__key").alias("__h2"), "__doc", "__tid", "__pos"
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose a line.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents stays only
    in the largest document that holds it. Returns ``<id_col>, text_id, n_dropped, drop_runs`` where ``drop_runs`` is
    ``array<struct<start,len>>`` of 0-based line positions, ascending; lines outside the runs are kept.
    """
    lines, _ = materialise(_hashed_lines(docs, id_col, text_col, min_chars), "lines")
    key = ["__h1", "__h2"]
    # Rows stream in as (h1) values; the pair is only needed to tell keys apart.
    top = lines.agg(F.expr(f"approx_top_k(__h1, {HOT_KEYS}, {SKETCH})").alias("top"))
    hot = F.broadcast(top.select(F.explode("top.item").alias("__h1")))  # at most HOT_KEYS rows

    hot_pairs = lines.join(hot, "__h1").select(*key, "__doc").distinct()
    hot_stats = (
        hot_pairs.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__doc").alias("__first"))
        .filter(F.col("__n") >= min_docs)
    )
    # A hot h1 stands for one key unless two keys collide in 64 bits, so this side has HOT_KEYS rows too.
    hot_drops = lines.join(F.broadcast(hot_stats), key).filter(F.col("__doc") != F.col("__first"))

    cold = lines.join(hot, "__h1", "left_anti").repartitionByRange(*key)
    run = Window.partitionBy(*key)
    stream = run.orderBy(F.col("__doc").desc(), F.col("__pos"))
    cold_drops = (
        cold.withColumn("__first", F.first("__doc").over(stream))
        .withColumn("__new", (~F.col("__doc").eqNullSafe(F.lag("__doc").over(stream))).cast("int"))
        .withColumn("__n", F.sum("__new").over(run))
        .filter((F.col("__doc") != F.col("__first")) & (F.col("__n") >= min_docs))
    )
    dropped = hot_drops.select("__doc", "__tid", "__pos").unionByName(cold_drops.select("__doc", "__tid", "__pos"))
    per_doc = dropped.groupBy("__doc", "__tid").agg(F.array_sort(F.collect_set("__pos")).alias("__p"))
    return per_doc.select(
        F.col("__doc").alias(id_col),
        F.col("__tid").alias("text_id"),
        F.size("__p").cast("long").alias("n_dropped"),
        _runs("__p").alias("drop_runs"),
    )


def _runs(p: str) -> Column:
    """Ascending positions as runs of neighbours."""
    return F.expr(
        f"""zip_with(filter({p}, (x, i) -> i = 0 OR get({p}, i - 1) <> x - 1),
                     filter({p}, (x, i) -> i = size({p}) - 1 OR get({p}, i + 1) <> x + 1),
                     (s, e) -> struct(s AS start, e - s + 1 AS len))"""
    )


def _mask(n_lines: str, runs: str) -> str:
    """SQL for a boolean array, true where the line stays: gaps between the runs, then the tail."""
    return f"""concat(
        flatten(transform({runs}, (r, i) -> concat(
            array_repeat(true, r.start - if(i = 0, 0, get({runs}, i - 1).start + get({runs}, i - 1).len)),
            array_repeat(false, r.len)))),
        array_repeat(true, {n_lines} - element_at({runs}, -1).start - element_at({runs}, -1).len))"""


def _marked(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, runs, n, before, after``: the rows of ``docs`` as one value each, in which no name can clash, their runs and
    dropped lines (null: none), and the text before (null: empty) and after. The only step in which texts move, by document."""
    marks = bitmaps.select(F.col(id_col).alias("id"), F.col("text_id").alias("tid"), F.col("n_dropped").alias("n"), F.col("drop_runs").alias("runs"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    field = F.col("doc").getField
    joined = rows.join(marks.hint("shuffle_hash"), (field(id_col) == F.col("id")) & (_text_id(field(text_col)) == F.col("tid")), "left")
    joined = joined.select("doc", "runs", "n", F.coalesce(field(text_col), F.lit("")).alias("before"))
    keep = f"""transform(array(split(before, '\\n', -1)), ls -> transform(array({_mask('size(ls)', 'runs')}),
               mask -> array_join(filter(ls, (l, i) -> get(mask, i)), '\\n'))[0])[0]"""
    return joined.withColumn("after", F.when(F.col("runs").isNull(), F.col("before")).otherwise(F.expr(keep)))


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str = "kept_text"
) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped, <kept>``, which replace columns of those names."""
    out = _marked(docs, bitmaps, id_col, text_col)
    lines = F.length("before").cast("long") - F.length(F.translate("before", "\n", "")).cast("long") + 1
    new = {"n_lines": lines, "n_dropped": F.coalesce("n", F.lit(0)).cast("long"), kept: F.col("after")}
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with the text replaced by its kept lines (null stays null); all other columns and all rows stay."""
    out = _marked(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    field = F.col("doc").getField
    text = F.when(field(text_col).isNotNull(), F.col("after"))
    return out.select(*[(text if c == text_col else field(c)).alias(c) for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest columns: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
      FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
