"""Quality rules by distribution divergence.

A text's histogram of character classes and its histogram of common words are held against
references of every language by the Jensen-Shannon distance.  References are counted over all
documents with a language: for a class, the median of its share over documents, which junk
moves little; for a word, its share of all words, and a language's common words are those of
the largest.  A text belongs to the language whose two distances add up to least, and fails where
one of them is above its limit.  Short texts lie far from any reference by chance, so limits
fall with the root of the number of words (and of the reference's own), and a histogram of too
few characters or words is not judged at all.  A language of fewer than ``MIN_DOCUMENTS``
documents has no reference; its texts are held against those of others.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.arrow import slices, with_columns
from conceptspark.runtime import stored

CLASSES = ("lower", "upper", "digit", "white", "stop", "other")
STOPS = ".,;:!?'\"()-"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Common words of a language, and the parts into which class shares are counted.
COMMON, PARTS = 50, 1000
#: Documents a language needs for a reference of its own.
MIN_DOCUMENTS = 5
#: Limits: so much, and so much over the root of the number of words.
CLASS_LIMIT, WORD_LIMIT = (0.05, 1.7), (0.05, 3.9)
#: A word of the reference counts as a quarter of one of the text's own for the limit of words.
REFERENCE_NOISE = 4
#: Guards: fewer characters or words than these tell nothing of a histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Entries a task's counts grow to before they are passed on, and characters worked on at once.
FLUSH, PART = 500_000, 1_000_000


@lru_cache(1)
def _table() -> np.ndarray:
    kinds = {"Ll": 0, "Lu": 1, "Nd": 2}
    out = np.full(0x110000, 5, dtype=np.uint8)
    for cp in range(0x110000):
        out[cp] = kinds.get(unicodedata.category(chr(cp)), 5)
    out[[ord(c) for c in WHITE]] = 3
    out[[ord(c) for c in STOPS]] = 4
    return out


def classes(text: str) -> np.ndarray:
    """Characters of each class, a part of the text at a time."""
    out = np.zeros(len(CLASSES), dtype=np.int64)
    for at in range(0, len(text), PART):
        cp = np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out += np.bincount(_table()[cp], minlength=len(CLASSES))
    return out


#: A-Z to small letters, everything else of ASCII that is no letter to a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z in small letters."""
    return data.translate(_LETTERS).split()


@dataclass
class References:
    """Languages, their class shares, common words and word shares (the last one of all other words)."""

    languages: list[str]
    class_shares: list[list[float]]
    common: list[list[str]]
    word_shares: list[list[float]]
    n_words: list[int]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON, min_documents: int = MIN_DOCUMENTS) -> References:
    """References of the languages of ``docs``, from all rows with a text and a language.

    Tasks add up their documents and pass sums on; what reaches the driver is one histogram
    of ``PARTS`` bins a class and ``common`` words a language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null and text <> ''")

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            for name, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array([k if isinstance(k, str) else k.decode("utf-8", "surrogatepass") for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "key", "amount"])
            held.clear()

        for b in batches:
            for lo, hi in slices([1] * b.num_rows, 200):
                for name, t in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist()):
                    c = classes(t)
                    own = held.setdefault(name, Counter())
                    own.update(f"#{k}:{n}" for k, n in enumerate(c * PARTS // c.sum()))
                    own.update(words(t.encode("utf-8", "surrogatepass")))
                if sum(map(len, held.values())) > FLUSH:
                    yield from out()
        yield from out()

    sums = rows.mapInArrow(count, "lang string, key string, amount long").groupBy("lang", "key").agg(F.sum("amount").alias("amount"))
    sums = stored(sums, "divergence-sums")
    bins: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in sums.where(F.col("key").startswith("#")).collect():
        k, at = r["key"][1:].split(":")
        bins.setdefault((r["lang"], int(k)), []).append((int(at), r["amount"]))
    own = sums.where(~F.col("key").startswith("#"))
    total = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.sum("amount").alias("n")).collect()}
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("amount").desc(), "key"))
    top: dict[str, list[tuple[str, int]]] = {}
    for r in own.withColumn("rank", rank).where(F.col("rank") <= common).orderBy("lang", "rank").collect():
        top.setdefault(r["lang"], []).append((r["key"], r["amount"]))
    refs = References([], [], [], [], [])
    for name in sorted({k[0] for k in bins}):
        if sum(n for _, n in bins[name, 0]) < min_documents or not total.get(name):
            continue
        share = np.array([median(bins[name, k]) for k in range(len(CLASSES))])
        found = [n / total[name] for _, n in top[name]]
        refs.languages.append(name)
        refs.class_shares.append(list(share / share.sum()))
        refs.common.append([w for w, _ in top[name]])
        refs.word_shares.append([*found, 1 - sum(found)])
        refs.n_words.append(total[name])
    return refs


def median(bins: list[tuple[int, int]]) -> float:
    """Middle of the bin that holds the lower median."""
    half, seen = sum(n for _, n in bins), 0
    for at, n in sorted(bins):
        seen += n
        if 2 * seen >= half:
            return (at + 0.5) / PARTS
    raise ValueError("no bins")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) along the last axis."""
    m = (p + q) / 2

    def part(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def base(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8; bytes split where the rules say."""
    said = data.split()
    trios = list(zip(said, said[1:], said[2:]))
    often = Counter(trios)
    repeated = 0
    if len(often) < len(trios):
        inside = bytearray(len(said))
        for i, t in enumerate(trios):
            if often[t] > 1:
                inside[i : i + 3] = b"\x01\x01\x01"
        repeated = sum(inside)
    lines = Counter(x for x in data.split(b"\n") if x.strip())
    chars = sum(len(w) for w in said) - sum(data.count(x) for x in _TAILS) if len(said) > 10**7 else len(b"".join(said).decode("utf-8", "surrogatepass"))
    return len(said), chars, sum(data.count(x) for x in SYMBOLS), sum(lines.values()) - len(lines), repeated


#: Bytes that go on a code point.
_TAILS = bytes(range(0x80, 0xC0))
RULES = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("language", T.StringType()), T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
]


def judge(data: list[bytes], n_words: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, language's place, class distance, word distance) of some texts in UTF-8."""
    counts = np.array([classes(d.decode("utf-8", "surrogatepass")) for d in data], dtype=np.float64).reshape(len(data), len(CLASSES))
    chars = counts.sum(axis=1)
    by_class = distance((counts / np.maximum(chars, 1)[:, None])[:, None], np.array(refs.class_shares)[None])
    size = max(map(len, refs.word_shares))
    shares = np.array([w[:-1] + [0.0] * (size - len(w)) + w[-1:] for w in refs.word_shares])
    places: dict[bytes, list[tuple[int, int]]] = {}
    for k, common in enumerate(refs.common):
        for at, w in enumerate(common):
            places.setdefault(w.encode("utf-8", "surrogatepass"), []).append((k, at))
    own = np.zeros((len(data), len(refs.languages), size))
    found = np.zeros(len(data))
    for i, d in enumerate(data):
        said = Counter(words(d))
        found[i] = sum(said.values())
        for w in said.keys() & places.keys():
            for k, at in places[w]:
                own[i, k, at] = said[w]
    own[:, :, -1] = found[:, None] - own.sum(axis=2)
    by_word = distance(own / np.maximum(found, 1)[:, None, None], shares[None])
    by_word[found == 0] = 1.0
    best = (by_class + by_word).argmin(axis=1)
    a, b = by_class[np.arange(len(data)), best], by_word[np.arange(len(data)), best]
    own, known = 1 / np.maximum(n_words, 1), REFERENCE_NOISE / np.array(refs.n_words)[best]
    strange = (chars >= MIN_CHARS) & (a > CLASS_LIMIT[0] + CLASS_LIMIT[1] * np.sqrt(own))
    foreign = (n_words >= MIN_WORDS) & (b > WORD_LIMIT[0] + WORD_LIMIT[1] * np.sqrt(own + known))
    return ~(strange | foreign), best, a, b


def rules(docs: DataFrame, refs: References, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed, kept, and the nearest language with both distances.

    A null text is an empty one: no words, failed.  Without any reference the base rules alone
    decide, and language and distances are null; so they are for texts without characters.  Rows
    are judged one by one, so repeated rows agree; an empty table gives an empty one.  Columns of
    these names are replaced, all others pass.
    """

    def work(data: list[bytes]) -> list[pa.Array]:
        counts = np.array([base(d) for d in data], dtype=np.int64).reshape(len(data), 5)
        n = counts[:, 0]
        failed = (n < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * n)
        kept, language, a, b = ~failed, [None] * len(data), [None] * len(data), [None] * len(data)
        if refs.languages:
            good, best, da, db = judge(data, n, refs)
            kept = kept & good
            some = [len(d) > 0 for d in data]
            language = [refs.languages[k] if s else None for k, s in zip(best, some)]
            a, b = ([float(x) if s else None for x, s in zip(v, some)] for v in (da, db))
        return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(language, pa.string()), pa.array(a, pa.float64()), pa.array(b, pa.float64())]

    return with_columns(docs, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), work, RULES)


def op12_quality_rules(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = rules(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_JS = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0::DOUBLE END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0.0::DOUBLE END"
_SAID = r"regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')"
_COUNTS = ", ".join(
    rf"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[.,;:!?''\x22()\-]")
)
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT id, i, list_slice(w, i, i + 2) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
cov AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS k FROM tri) WHERE k > 1) GROUP BY id),
lin AS (SELECT id, CAST(sum(k - 1) AS BIGINT) AS n FROM (SELECT id, l, count(*) AS k FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id, l) GROUP BY id),
b AS (SELECT d.id, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(lin.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d JOIN w USING (id) LEFT JOIN cov USING (id) LEFT JOIN lin USING (id)),
cls AS (SELECT id, lang, size, list_append(c, size - list_sum(c)) AS c FROM (SELECT id, lang, length(t) AS size, [{_COUNTS}] AS c FROM d) WHERE size > 0),
bins AS (SELECT lang, k, CAST(c[k] * {PARTS} // size AS BIGINT) AS bin, count(*) AS n FROM cls, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) WHERE lang IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lang, k ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, k) AS total FROM bins),
med AS (SELECT lang, k, (min(bin) + 0.5::DOUBLE) / {PARTS} AS share FROM cum WHERE 2 * upto >= total AND total >= {MIN_DOCUMENTS} GROUP BY lang, k),
said AS (SELECT id, lang, word, count(*) AS n FROM (SELECT id, lang, unnest({_SAID}) AS word FROM d) GROUP BY ALL),
voc AS (SELECT lang, word, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM said WHERE lang IS NOT NULL GROUP BY lang, word),
top AS (SELECT lang, word, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS q, total FROM voc QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word)) <= {COMMON}),
ref AS (SELECT lang, list(share / s ORDER BY k) AS cs FROM (SELECT *, sum(share) OVER (PARTITION BY lang) AS s FROM med) WHERE lang IN (SELECT lang FROM top) GROUP BY lang),
rest AS (SELECT lang, 1 - sum(q) AS q, {REFERENCE_NOISE} / CAST(max(total) AS DOUBLE) AS noise FROM top GROUP BY lang),
a AS (SELECT id, r.lang, sqrt(greatest(0, list_sum([{_JS.format(p='(c[k] / CAST(size AS DOUBLE))', q='cs[k]')} for k in [1, 2, 3, 4, 5, 6]]) / 2)) AS da FROM cls, ref r),
tot AS (SELECT id, CAST(sum(n) AS DOUBLE) AS n FROM said GROUP BY id),
hits AS (SELECT s.id, t.lang, sum({_JS.format(p='(s.n / tot.n)', q='t.q')} - t.q) AS more, sum(s.n / tot.n) AS mass FROM said s JOIN top t USING (word) JOIN tot USING (id) GROUP BY s.id, t.lang),
e AS (SELECT tot.id, r.lang, coalesce(h.more, 0) AS more, 1 - coalesce(h.mass, 0) AS p, r.q FROM tot CROSS JOIN rest r LEFT JOIN hits h ON h.id = tot.id AND h.lang = r.lang),
bw AS (SELECT id, lang, sqrt(greatest(0, (more + (1 - q) + {_JS.format(p='p', q='q')}) / 2)) AS db FROM e),
best AS (SELECT id, da, coalesce(db, 1) AS db, noise FROM a LEFT JOIN bw USING (id, lang) LEFT JOIN rest USING (lang) QUALIFY row_number() OVER (PARTITION BY id ORDER BY da + coalesce(db, 1), lang) = 1),
f AS (SELECT b.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, da, db, size, noise FROM b LEFT JOIN best USING (id) LEFT JOIN cls USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(size >= {MIN_CHARS} AND da > {CLASS_LIMIT[0]}::DOUBLE + {CLASS_LIMIT[1]}::DOUBLE * sqrt(1 / greatest(n_words, 1)), false) OR coalesce(n_words >= {MIN_WORDS} AND db > {WORD_LIMIT[0]}::DOUBLE + {WORD_LIMIT[1]}::DOUBLE * sqrt(1 / greatest(n_words, 1) + noise), false)) AS kept
FROM f
"""
