"""Quality rules: counts within each document, and lines that too many documents of a host share.

DataFrame functions only. One reading of the texts writes each document's counts and the hashes of
its different lines; the rest moves hashes. (host and line, document) pairs are made distinct, counted
by line with map-side sums, and only lines above the limit return to their documents, whose texts lose them. Documents that are exact copies
count once, so a copied document doesn't turn its own lines into boilerplate. Lines are told apart by 64 bits of hash, documents by 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import HEAVY, few, free_name, heavy_join, stage

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
#: A line is boilerplate if over so many different documents of its host have it.
MAX_DOCUMENTS_PER_HOST = 50
#: A document is depleted if its boilerplate lines have over this share of the words of its different lines.
MAX_REMOVED_SHARE = 0.7


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to rows with a text ``_t``, and ``_lines``.

    ``_lines``: the different normalised lines that have a word.
    """
    kept = docs.columns
    step = docs.select("*", F.btrim("_t", F.lit(BLANK_CHARS)).alias("_b"))
    step = step.select(*kept, F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", BLANKS)).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    step = step.select(
        *kept, "_l", F.size("_w").alias("_n"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.expr("case when size(_w) < 3 then array() else transform(arrays_zip(slice(_w, 1, size(_w) - 2), slice(_w, 2, size(_w) - 2), slice(_w, 3, size(_w) - 2)), x -> xxhash64(x)) end").cast("array<bigint>").alias("_h"),
    )
    # only texts with a repeated window pay for the sort
    step = step.select("*", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (x, i) -> struct(x as h, i as i))) end").alias("_s"))
    step = step.drop("_h").select("*", F.expr("zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (a, b) -> a.h = b.h)").alias("_e"))
    step = step.select("*", F.expr("sort_array(transform(filter(arrays_zip(_s, concat(array(false), _e), concat(_e, array(false))), x -> x['1'] or x['2']), x -> x._s.i))").alias("_p"))
    return step.select(
        *kept, F.col("_n").cast("long").alias("n_words"), "word_chars",
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr("aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least(3, coalesce(b - a, 3))), 0, (s, x) -> s + x)"), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_distinct(F.transform("_l", lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(BLANK_CHARS)), BLANKS, " ")))).alias("_lines"),
    )


def line_hash(host: Column, line: Column) -> Column:
    """Hash of a normalised line of a host."""
    return F.xxhash64(host, line)


def normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANK_CHARS)), BLANKS, " "))


def _rows(docs: DataFrame, text_col: str, host_col: str, keep: dict[str, Column]) -> DataFrame:
    """``keep``, _t, _host and _doc (128-bit hash of both)."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("_host"))
    return rows.withColumn("_doc", F.struct(F.xxhash64("_host", "_t").alias("a"), F.xxhash64(F.lit(1), "_host", "_t").alias("b")))


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_documents: int) -> tuple[DataFrame, DataFrame]:
    """Stored: a row for each row of ``docs`` (doc_id, _doc, counts, _line_words), and the boilerplate (_doc, lines: hashes, removed: words, n: rows) of each different document that has any."""
    rows = base_counts(_rows(docs, text_col, host_col, {"doc_id": F.col(id_col)}))
    sizes = F.transform("_lines", lambda x: F.size(F.split(x, " ")))
    rows = rows.withColumns({"_hl": F.transform("_lines", lambda x: line_hash(F.col("_host"), x)), "_n": sizes})
    rows = stage(rows.select("doc_id", "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_hl", "_n"), "line-hashes")
    pairs = rows.select("_doc", F.explode(F.arrays_zip("_hl", "_n")).alias("x")).select("_doc", F.col("x._hl").alias("hl"), F.col("x._n").alias("n"))
    pairs = pairs.groupBy("hl", "_doc").agg(F.max("n").alias("n"))
    counted = stage(pairs.groupBy("hl").agg(F.count("*").alias("n")).filter(F.col("n") > max_documents), "common-lines")
    # a common line may be in a third of all documents
    removed = heavy_join(pairs, counted.select("hl", F.lit(True).alias("_common")), "hl", counted, "_doc") if counted.count() > HEAVY else pairs.join(F.broadcast(counted.select("hl")), "hl")
    removed = removed.groupBy("_doc").agg(F.collect_set("hl").alias("lines"), F.sum("n").alias("removed"))
    copies = rows.groupBy("_doc").agg(F.count("*").alias("n"))
    return rows, stage(removed.join(copies, "_doc"), "boilerplate")


def judge(rows: DataFrame, gone: DataFrame, max_removed: float) -> DataFrame:
    """Verdict of every row of ``measure``."""
    line_words = F.aggregate("_n", F.lit(0), lambda s, x: s + x)
    narrow = rows.select("doc_id", "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", line_words.alias("_line_words"))
    n = gone.count()
    touched = narrow.join(few(gone.select("_doc"), n), "_doc", "left_semi")
    touched = heavy_join(touched, gone.select("_doc", F.col("removed").cast("long").alias("n_removed_words")), "_doc", gone.select("_doc", "n"), "doc_id")
    whole = narrow.join(few(gone.select("_doc"), n), "_doc", "left_anti").withColumn("n_removed_words", F.lit(0).cast("long"))
    out = whole.union(touched.select(*whole.columns))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    depleted = F.col("n_removed_words") > max_removed * F.col("_line_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS_PER_HOST, max_removed: float = MAX_REMOVED_SHARE) -> DataFrame:
    """Counts and verdict for every row: doc_id, the five counts, n_removed_words, base_failed, kept.

    Null and empty texts have no words and fail. A null host is a host of its own. Rows that repeat
    id, text and host get the same answer each. Ids may be null. An empty table gives an empty one. Other columns are ignored.
    """
    rows, gone = measure(docs, id_col, text_col, host_col, max_documents)
    return judge(rows, gone, max_removed).drop("_doc", "_line_words")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS_PER_HOST, max_removed: float = MAX_REMOVED_SHARE) -> DataFrame:
    """The rows that ``apply_rules`` keeps, with all their columns, their texts without the lines that too many documents of their host share.

    Other lines, blank ones too, stay as they are. Columns may have any names.
    """
    rows, gone = measure(docs, id_col, text_col, host_col, max_documents)
    bad = stage(judge(rows, gone, max_removed).filter("not kept").select("_doc").distinct(), "rejected-documents")
    doc, host, bad_doc, lines_doc, lines = (free_name(docs, x) for x in ("doc", "host", "bad_doc", "lines_doc", "lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")))
    keyed = keyed.withColumn(doc, F.struct(F.xxhash64(host, text).alias("a"), F.xxhash64(F.lit(1), host, text).alias("b")))
    kept = keyed.join(few(bad.select(F.col("_doc").alias(bad_doc)), bad.count()), F.col(doc) == F.col(bad_doc), "left_anti")
    n = gone.count()
    gone = gone.select(F.col("_doc").alias(lines_doc), F.col("lines").alias(lines))
    changed = kept.join(few(gone.select(lines_doc), n), F.col(doc) == F.col(lines_doc), "left_semi").join(gone, F.col(doc) == F.col(lines_doc))
    own = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(lines, line_hash(F.col(host), normal(x)))), "\n")
    whole = kept.join(few(gone.select(lines_doc), n), F.col(doc) == F.col(lines_doc), "left_anti").select(*docs.columns)
    return whole.union(changed.select(*[own.alias(c) if c == text_col else F.col(c) for c in docs.columns]))


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, chr(1)) as host from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
c as (select doc_id, t, host, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
      list_distinct(list_transform(l, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))))) as lines, w from w),
u as (select distinct t, w from c),
g as (select t, unnest(range(1, len(w) - 1)) as i, w from u where len(w) > 2),
k as (select t, i, count(*) over (partition by t, w[i], w[i + 1], w[i + 2]) as n from g),
r as (select t, sum(least(3, coalesce(nxt - i, 3))) as n_repeat_words from (select t, i, lead(i) over (partition by t order by i) as nxt from k where n > 1) group by t),
x as (select distinct host, t, unnest(lines) as line from c),
f as (select host, line from x group by host, line having count(*) > {MAX_DOCUMENTS_PER_HOST}),
v as (select host, t, sum(len(string_split(line, ' '))) as all_words, sum(case when f.line is not null then len(string_split(x.line, ' ')) else 0 end) as removed from x left join f using (host, line) group by host, t),
o as (select c.*, coalesce(r.n_repeat_words, 0) as n_repeat_words, coalesce(v.removed, 0) as n_removed_words, coalesce(v.all_words, 0) as all_words,
      (n_words < 50 or 100 * coalesce(r.n_repeat_words, 0) > 50 * n_words) as base_failed from c left join r using (t) left join v using (host, t))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, n_removed_words::bigint as n_removed_words,
 base_failed, not base_failed and not (n_removed_words > {MAX_REMOVED_SHARE} * all_words) as kept from o
"""
