"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is a list of words (split at ASCII white space, in lower case). Of lines with equal words the earliest
stays, by doc_id and then place. Of lines of `least_words` words or more, one also goes if an earlier one, itself kept
or not, is within one word edit: a word changed, added or left out. Lines without words always stay.

For the second rule each line emits the hashes of all variants with one word left out, and of itself. Two lines that
differ in word i share the variant without it; a line with a word added has the other line as a variant. Equal
variants meet in an aggregation that keeps the earliest line only, so a variant that very many lines share costs a
row for each line and not for each pair. The words of a line and its earliest match are then compared.

Only lines that share their first or last half with a different line can have such a match, so the halves are hashed
first and all other lines emit nothing. The hash of a variant is put together from those of what is before, in and
after a block of words, so a line of n words costs about n**1.5 word hashes.

Null texts stay null; empty texts stay empty. A document is known by its doc_id (null or not) and a hash of its text,
so rows that share a doc_id but not their text are documents of their own, in the order of that hash; rows that repeat
both are one document and are treated alike. An empty table gives no rows. Other columns pass through, whatever their
names; only n_lines, n_exact and n_near are replaced, if counts are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, let

LEAST_WORDS = 8


def normal(line: Column) -> Column:
    """In lower case, words between single spaces."""
    low = F.lower(line)
    odd = low.contains("  ")
    for c in "\t\v\f\r":
        odd = odd | low.contains(c)
    return F.btrim(F.when(odd, F.regexp_replace(low, r"[\x09-\x0D\x20]+", " ")).otherwise(low), F.lit(" "))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line) of docs (doc_id, th, text), lines in normal form, those without words left out."""
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x09-\x0D\x20]")).select("doc_id", "th", "line_no", normal(F.col("line")).alias("line"))


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and the last h words, for each h that half of a line within one edit can have."""
    h, g = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    ends = lambda k: [F.xxhash64(F.lit("p"), k, part(k)), F.xxhash64(F.lit("s"), k, part(-k))]
    return F.when(n % 2 == 1, F.array(*ends(h))).otherwise(F.array(*ends(h), *ends(g)))


def block_of(n: Column) -> Column:
    """Words of a block for variants of n words: a power of two, near the root of n for long lines."""
    return F.greatest(F.lit(32), F.pow(F.lit(2), F.ceil(F.log2(n + 1) / 2)).cast("int"))


def with_blocks(lines: DataFrame) -> DataFrame:
    """Adds n, block (of variants with a word left out), the hashes before and after each block, and own: the hashes
    under which the line itself is found as a variant of a longer one."""
    w, n = F.col("words"), F.col("n")
    blocks = lines.withColumn("n", F.size("words")).withColumns({"block": block_of(n - 1), "b": block_of(n)})
    return blocks.select(
        "ord", "words", "n", "block",
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.col("block")).cast("int")), lambda j: F.xxhash64(F.slice(w, F.lit(1), j * F.col("block")))).alias("before"),
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.col("block")).cast("int")), lambda j: F.xxhash64(F.slice(w, (j + 1) * F.col("block") + 1, n))).alias("after"),
        F.transform(F.sequence(F.lit(0), F.floor(n / F.col("b")).cast("int")), lambda j: F.xxhash64(j, n, F.xxhash64(F.slice(w, F.lit(1), j * F.col("b"))), F.xxhash64(F.slice(w, j * F.col("b") + 1, F.col("b") - 1)), F.xxhash64(F.slice(w, (j + 1) * F.col("b"), n)))).alias("own"),
    )


def variants(lines: DataFrame) -> DataFrame:
    """(key, i, ord): every line of with_blocks() with word i left out."""
    w, b = F.col("words"), F.col("block")

    def variant(i: Column) -> Column:
        j = F.floor((i - 1) / b).cast("int")
        rest = F.concat(F.slice(w, j * b + 1, i - 1 - j * b), F.slice(w, i + 1, (j + 1) * b - i))
        return F.struct(F.xxhash64(j, F.col("n") - 1, F.get("before", j), F.xxhash64(rest), F.get("after", j)).alias("key"), i.alias("i"))

    return lines.select("ord", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), variant)).alias("v")).select("v.key", "v.i", "ord")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether word lists differ by at most one word changed, added or left out: they agree before and after a word."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    rest = lambda x, k: F.slice(x, k, F.size(x) + 1)
    same = F.size(a) == F.size(b)
    longer = F.size(a) == F.size(b) + 1
    shorter = F.size(a) + 1 == F.size(b)
    p = F.greatest(first, F.lit(1))
    return (first == 0) | (same & (rest(a, p + 1) == rest(b, p + 1))) | (longer & (rest(a, p + 1) == rest(b, p))) | (shorter & (rest(a, p) == rest(b, p + 1)))


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, line_no, near) of the lines to drop from docs (doc_id, th, text); near is false for exact copies."""
    scratch = Scratch(docs.sparkSession, "lines")
    line, at = F.col("line"), F.struct("doc_id", "th", "line_no")
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    halves = F.when(F.col("n") >= least_words, half_keys(line, F.col("n"))).alias("halves")
    slim = scratch.keep(lines_of(docs).withColumn("n", n).select("doc_id", "th", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), halves))
    firsts = scratch.keep(slim.groupBy("h", "g").agg(F.min(at).alias("ord"), F.count(F.lit(1)).alias("copies"), F.any_value("halves").alias("halves")))
    repeated = firsts.filter("copies > 1").select("h", "g", "ord")
    exact = scratch.keep(slim.drop("halves").join(repeated, ["h", "g"]).filter(~at.eqNullSafe(F.col("ord"))).select("doc_id", "th", "line_no"))
    scratch.drop(slim)

    half = firsts.filter("halves is not null").select("ord", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    wanted = scratch.keep(half.join(shared, "half", "left_semi").select("ord").distinct())
    scratch.drop(firsts)
    by_text = wanted.groupBy(F.col("ord.doc_id").alias("d"), F.col("ord.th").alias("t")).agg(F.collect_list("ord.line_no").alias("at_lines"))  # of one document
    # texts are always brought together by a shuffle, so that the plan is the same at every size
    found = docs.hint("merge").join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    lines_at = let(F.split("text", "\n"), lambda x: F.transform("at_lines", lambda i: F.struct(i.alias("line_no"), F.get(x, i).alias("line"))))
    found = found.select("doc_id", "th", F.explode(lines_at).alias("x")).select(F.struct("doc_id", "th", "x.line_no").alias("ord"), F.split(normal(F.col("x.line")), " ").alias("words"))
    lines = scratch.keep(with_blocks(found.dropDuplicates(["ord"])))
    scratch.drop(wanted)

    # what is alike meets under a key; only keys that meet another are looked at again
    own = lines.select(F.explode("own").alias("key"), F.lit(0).alias("i"), "ord")
    each = scratch.keep(variants(lines).select("key", "i", "ord").union(own))
    meeting = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    alike = scratch.keep(each.join(meeting, "key", "left_semi"))
    scratch.drop(each)
    cut = alike.filter("i > 0")
    first = cut.groupBy("key", "i").agg(F.min("ord").alias("earliest"))
    changed = cut.join(first, ["key", "i"]).select("ord", "earliest").filter("earliest < ord").distinct()
    added = scratch.keep(cut.join(alike.filter("i = 0").select("key", F.col("ord").alias("other")), "key").select("ord", "other").distinct())
    earlier = changed.union(added).union(added.groupBy("other").agg(F.min("ord")))
    pairs = scratch.keep(earlier.filter(F.col("earliest") < F.col("ord")).distinct())
    words = lines.select(F.col("ord").alias("o"), F.col("words").alias("a"))
    both = pairs.join(words, F.col("ord").eqNullSafe(F.col("o"))).drop("o")
    both = both.join(words.withColumnRenamed("a", "b"), F.col("earliest").eqNullSafe(F.col("o")))
    near = both.filter(within_one_edit(F.col("a"), F.col("b"))).select("ord.doc_id", "ord.th", "ord.line_no").distinct()
    gone = scratch.keep(exact.withColumn("near", F.lit(False)).union(near.withColumn("near", F.lit(True))))
    scratch.drop_all_but(gone)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, counts: bool = True) -> DataFrame:
    """docs with text_col reduced to the lines that stay. counts: adds n_lines, n_exact and n_near (the last two count
    dropped lines). Other columns pass through."""
    th = F.xxhash64(docs[text_col])
    gone = dropped_lines(docs.select(docs[id_col].alias("doc_id"), th.alias("th"), docs[text_col].alias("text")).filter("text is not null"), least_words)
    own_id, own_th, lines, near, exact = fresh(docs, "__id", "__th", "__gone", "__near", "__exact")
    each = gone.groupBy(F.col("doc_id").alias(own_id), F.col("th").alias(own_th)).agg(F.array_sort(F.collect_set("line_no")).alias(lines), F.count_if("near").alias(near), F.count_if(~F.col("near")).alias(exact))
    joined = docs.hint("merge").join(each, docs[id_col].eqNullSafe(F.col(own_id)) & (th == F.col(own_th)), "left")

    def kept(x: Column) -> Column:
        """What stands between dropped lines, each run taken at once."""
        edges = F.concat(F.array(F.lit(-1)), F.col(lines), F.array(F.size(x)))
        return let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: F.slice(x, F.get(e, j) + 2, F.get(e, j + 1) - F.get(e, j) - 1))))

    text = F.when(F.col(lines).isNull(), joined[text_col]).otherwise(F.array_join(let(F.split(joined[text_col], "\n"), kept), "\n"))
    out = [text.alias(c) if c == text_col else joined[c] for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_exact", "n_near")]
    if counts:
        out += [F.coalesce(F.size(F.split(joined[text_col], "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(exact, F.lit(0)).alias("n_exact"), F.coalesce(near, F.lit(0)).alias("n_near")]
    return joined.select(out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_lines", "n_exact", "n_near", "text")


ORACLE_SQL = """
with lines as (
    select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line
    from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)
), worded as (
    select doc_id, line_no, list_filter(string_split_regex(lower(line), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') as words
    from lines
), ranked as (
    select doc_id, line_no, words, row_number() over (order by doc_id, line_no) as o, row_number() over (partition by words order by doc_id, line_no) as copy
    from worded where len(words) > 0
), long_lines as (
    select o, words, len(words) as n from ranked where copy = 1 and len(words) >= 8
), cuts as (
    select o, n, words, unnest(range(1, n + 1)) as i from long_lines
), variants as (
    select o, n, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') as v from cuts
), near as (
    select a.o from variants a join variants b on a.v = b.v and a.i = b.i and a.n = b.n and b.o < a.o
    union select a.o from variants a join long_lines b on a.v = array_to_string(b.words, ' ') and b.n = a.n - 1 and b.o < a.o
    union select b.o from variants a join long_lines b on a.v = array_to_string(b.words, ' ') and b.n = a.n - 1 and a.o < b.o
), gone as (
    select doc_id, line_no, false as near from ranked where copy > 1
    union all select doc_id, line_no, true from ranked join near using (o)
), kept as (
    select l.doc_id, count(*) as n_lines, count(*) filter (g.near = false) as n_exact, count(*) filter (g.near) as n_near,
        coalesce(string_agg(l.line, chr(10) order by l.line_no) filter (g.near is null), '') as text
    from lines l left join gone g on l.doc_id = g.doc_id and l.line_no = g.line_no group by l.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_exact, 0) as n_exact, coalesce(k.n_near, 0) as n_near, k.text
from documents d left join kept k using (doc_id)
"""
