"""Spelling variants: words one edit apart, found by PartEnum signatures.

A word's multiset of letters is a binary vector (a bit for the first e, the second e, and so
on).  One inserted or deleted letter changes one bit, one replaced letter two, so near words'
vectors are at a Hamming distance of two at most.  Letters are dealt into ``PARTS`` parts of
about equal weight; of these at most two differ, so near words agree exactly on the letters of
all parts but some two.  Enumerating which two are left out gives a word's signatures, and
words that share one are candidates.  An edit also leaves the first letters or the last ones in
place, which is joined to the signature: candidates become fewer, and none is lost.

Signatures meet in an equi-join that verifies pairs as it makes them, so only near pairs leave
it.  Everything is DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.llm.talk_repair import CRC_SQL, crc_sql
from conceptspark.runtime import stored

#: Parts of the alphabet, of which two may differ.
PARTS = 5
#: Letters at the beginning of a word, and at its end, of which an edit leaves one group in place.
FIRST, LAST = 3, 4
#: Words are of this many code points and this many occurrences at least.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: One of so many (document, run) pairs loses a letter.
DAMAGE = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]"


def damaged_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_LENGTH) -> DataFrame:
    """(word): the letter runs of every text, A-Z in small letters, some with a letter deleted.

    Runs shorter than ``least`` can't become words and are left out.  A null text has no runs; a
    null id reads as an empty one.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{RUN}{{{least},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), runs.alias("run"))
    rows = rows.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    rows = rows.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    return rows.select(F.when(F.col("h") % DAMAGE == 0, F.expr("concat(substring(run, 1, at), substring(run, at + 2))")).otherwise(F.col("run")).alias("word"))


def count(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def parts_of(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of ``words`` dealt into parts of about equal numbers of letters.

    A row per letter of the alphabet comes to the driver.  Which part a letter is in changes
    the number of candidates, never the result.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    out, load = [""] * parts, [0] * parts
    for r in letters.orderBy(F.col("n").desc(), "c").collect():
        k = load.index(min(load))
        out[k] += r["c"]
        load[k] += r["n"]
    return out


def near_pairs(words: DataFrame, parts: int = PARTS, first: int = FIRST, last: int = LAST) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (word, n), a before b, that one edit apart, once.

    Words must have ``first + last`` code points at least: an edit after the first ``first``
    leaves those, an earlier one the last ``last``.
    """
    groups = parts_of(words, parts)
    bag = F.array_join(F.array_sort(F.split("word", "")), "")
    rows = words.select("word", "n", bag.alias("bag"))
    keys = []
    for i, gone in enumerate(combinations(groups, 2)):
        left = F.translate("bag", "".join(gone), "") if any(gone) else F.col("bag")
        keys += [F.xxhash64(F.lit(2 * i), left, F.substring("word", 1, first)), F.xxhash64(F.lit(2 * i + 1), left, F.substring("word", -last, last))]
    signed = rows.select(F.explode(F.array(*keys)).alias("key"), "word", "n")
    a, b = signed.alias("a"), signed.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & (F.abs(F.length("a.word") - F.length("b.word")) <= 1) & (F.levenshtein("a.word", "b.word", 1) == 1)
    met = a.join(b, near).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
    return met.distinct()


def roots(forms: DataFrame, rounds: int = 6) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: the end of each word's chain of forms.

    Every round doubles the steps taken.  A form is ``TIMES`` times as frequent as its variant,
    so chains have fewer than 20 steps and five rounds reach their ends.
    """
    out = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(rounds):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = stored(out.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if out.where("moved").limit(1).count() == 0:
            break
        out = out.select("word", "root")
    return out.select("word", "root")


def group(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    A word's form is its near word of largest n, of equal ones the first in code-point order, if
    that n is ``times`` the word's own or more.  A word without one is its own root, and an
    empty table gives an empty one.
    """
    words = stored(words, "variant-words")
    pairs = near_pairs(words)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("w")).select("w.*")
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"), F.max("n").alias("n"))
    is_form = -F.col("best.m") >= times * F.col("n")
    near = stored(best.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "variant-near")
    ends = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_variants(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group(count(damaged_runs(docs)))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{MIN_LENGTH},}}')) AS run FROM documents),
keyed AS (SELECT run, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, {crc_sql('key')} AS h FROM keyed, tab),
said AS (SELECT k, CASE WHEN h % {DAMAGE} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM said WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
del AS (SELECT word, n, p, left(word, CAST(p AS INTEGER)) || substr(word, CAST(p + 2 AS INTEGER)) AS d FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)),
ways AS (
  SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM del x JOIN del y ON x.d = y.d AND x.p = y.p AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM del x JOIN w y ON x.d = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM del x JOIN w y ON x.d = y.word),
best AS (SELECT word, count(*) AS n_near FROM ways GROUP BY word),
top AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
form AS (SELECT word, other AS form, other_n AS form_n FROM top WHERE other_n >= {TIMES} * n),
walk AS (SELECT word, form AS pos FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.pos),
ends AS (SELECT word, pos AS root FROM walk WHERE pos NOT IN (SELECT word FROM form))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM w LEFT JOIN form f USING (word) LEFT JOIN ends e USING (word) LEFT JOIN best b USING (word)
"""
