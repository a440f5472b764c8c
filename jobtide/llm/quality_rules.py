"""Quality rules: base counts of a text, and how far its histograms diverge from those of languages. Built-in expressions only."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtide.llm.common import let, words_of
from jobtide.sources.shared import broadcast_if_small, written

# ---- fixed values: the most frequent words of each language, most frequent first -------------------------------
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as are by be this at from".split(),
    "fr": "de la le et les des en un du que une par pour est dans qui sur pas au avec".split(),
    "de": "der die und in den von zu das sich mit des nicht auf im für ist dem ein als eine".split(),
    "es": "de la que el en y un los se del las por no con una para su al es lo".split(),
}
# shares of character classes in running text: small letters, capitals, digits, spaces, punctuation, anything else
CHARACTER_SHARES = {
    "en": (0.760, 0.025, 0.005, 0.175, 0.030, 0.005),
    "fr": (0.760, 0.025, 0.005, 0.170, 0.035, 0.005),
    "de": (0.765, 0.055, 0.005, 0.145, 0.025, 0.005),
    "es": (0.765, 0.022, 0.005, 0.175, 0.028, 0.005),
}
PUNCTUATION = ".,;:?'\"()-"
# ---- end of fixed values ----------------------------------------------------------------------------------------

#: Share of running words that the common words make up together; within it the n-th has a share like 1 / n.
_COMMON_SHARE = 0.33
_CLASSES = 6


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


class References(NamedTuple):
    """Histograms of languages, and the largest distances from the nearest of them that are let pass.

    ``characters``: of each language the shares of the character classes; ``words``: its common words with their shares of running words.
    """

    characters: dict[str, tuple[float, ...]]
    words: dict[str, dict[str, float]]
    max_char_distance: float
    max_word_distance: float


def _typed() -> References:
    """References without any text to fit them on."""
    weights = [1 / i for i in range(1, 21)]
    words = {lang: {w: _COMMON_SHARE * x / sum(weights) for w, x in zip(common, weights)} for lang, common in COMMON_WORDS.items()}
    return References(CHARACTER_SHARES, words, 0.16, 0.38)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    languages: int = 8,
    common: int = 24,
    lose: float = 0.01,
    char_guard: int = 100,
    word_guard: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> References:
    """Fit the histograms of the most frequent ``languages`` on ``docs``, and calibrate the limits on ``labels`` (doc_id, quality, toxic).

    Half of the rows that labels call good and not toxic are held out, by hash of their id. All rows of a language without these and without those that labels
    call bad or toxic give its shares of character classes and its ``common`` most frequent words. The limits are what all but a share ``lose`` of all held-out rows keep,
    rounded up to four places; without such rows nothing is too far. Rows without id or language give no histogram; of equal counts the alphabetically lower language
    and word comes first. Ids of labels meet the texts by broadcast if they are small; else Spark chooses the join.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    named = labels.where("doc_id IS NOT NULL")
    bad = named.where("quality = 0 OR toxic = 1").select("doc_id").distinct()
    top = [r.lang for r in rows.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    draw = F.md5(F.col("doc_id").cast("string"))
    good = named.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct().join(bad, "doc_id", "left_anti").where(F.substring(draw, 1, 1) < "8")
    good = written(good, "held-out")
    left_out = written(bad.unionByName(good), "left-out")
    texts = rows.where(F.col("lang").isin(top)).join(broadcast_if_small(left_out), "doc_id", "left_anti").select("lang", F.coalesce("text", F.lit("")).alias("text"))

    size = {r.lang: r.n for r in texts.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    spelled = texts.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    spelled = written(spelled, "spelled")  # classes and small letters are worked out once for each different word
    classes = spelled.select("lang", "n", _character_histogram(F.col("word"), F.length("word")).alias("h"))
    sums = {r.lang: r.h for r in classes.groupBy("lang").agg(F.array(*[F.sum(F.col("h")[i] * F.col("n")) for i in range(_CLASSES)]).alias("h")).collect()}
    histograms = {lang: [*h[:3], n - sum(h), *h[4:]] for lang, n in sorted(size.items()) for h in [sums.get(lang, [0] * _CLASSES)]}  # what is not in words are spaces
    characters = {lang: tuple(n / max(1, sum(h)) for n in h) for lang, h in histograms.items()}

    running = spelled.select("lang", _bare(F.col("word")).alias("word"), "n").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    running = written(running, "words")
    ranked = running.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= common)
    total = {r.lang: r.n for r in running.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    words: dict[str, dict[str, float]] = {lang: {} for lang in sorted(total)}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r.place)):
        words[r.lang][r.word] = r.n / total[r.lang]

    found = References(characters, words, math.inf, math.inf)
    held = rows.join(broadcast_if_small(good), "doc_id").select(judged(F.col("text"), references=found, char_guard=char_guard, word_guard=word_guard).alias("j"))
    held = written(held.select("j.char_distance", "j.word_distance"), "distances")
    limits = [_percentile(held, c, 1 - lose) for c in held.columns]
    return found._replace(**{n: math.inf if x is None else math.ceil(x * 10_000) / 10_000 for n, x in zip(("max_char_distance", "max_word_distance"), limits)})


def _percentile(rows: DataFrame, column: str, share: float) -> float | None:
    """The percentile, as ``F.percentile`` has it, of a column of distances (0 to 1): equal ones are counted by steps first, then only those of the steps it lies in, so that no task holds all."""
    values = rows.select(F.col(column).alias("x")).where("x IS NOT NULL")
    step = F.floor(F.col("x") * 100_000)
    steps = sorted(values.groupBy(step.alias("x")).count().collect())
    if not steps:
        return None
    at = (sum(n for _, n in steps) - 1) * share
    ends = [math.floor(at), math.ceil(at)]

    def reaching(counts: list, start: int, place: int) -> tuple[float, int]:
        """The first value whose counts, added up from ``start``, go beyond a place, and what came before it."""
        for value, n in counts:
            if start + n > place:
                return value, start
            start += n
        return counts[-1][0], start

    first, start = reaching(steps, 0, ends[0])
    exact = sorted(values.where(step.isin(first, reaching(steps, 0, ends[1])[0])).groupBy("x").count().collect())
    low, high = (reaching(exact, start, place)[0] for place in ends)
    return low if low == high else (ends[1] - at) * low + (at - ends[0]) * high


def quality_rules(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with its columns and those in NAMES, the fields of ``judged``, whose limits can be given.

    An input column with the name of a result is replaced. Each row is judged alone, so there is no shuffle, and repeated rows
    get equal results.
    """
    kept = [c for c in docs.columns if c not in NAMES]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], judged(F.col(f"`{text_col}`"), **limits).alias("rules"))
    return docs.select(row.alias("row")).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], *[f"row.rules.{n}" for n in NAMES])


def judged(
    text: Column,
    min_words: int = 20,
    max_repeated_pct: int = 30,
    max_char_distance: float | None = None,
    max_word_distance: float | None = None,
    char_guard: int = 100,
    word_guard: int = 50,
    references: References | None = None,
) -> Column:
    """Counts, distances and verdict of a text as one struct, which is worked out once.

    Distances are Jensen-Shannon distances (0 to 1) of the text's histogram of character classes, and of common
    words, to the nearest language. A text with under ``char_guard`` characters in words or ``word_guard`` words has too small a
    histogram, so that distance is null and rejects nothing. ``kept``: the base rules hold and no distance is too large.
    Null and empty texts have no words and fail. ``references`` come from ``fit``, or are the stated ones above; limits given beside them come first.
    """
    known = references or _typed()
    max_char_distance = known.max_char_distance if max_char_distance is None else max_char_distance
    max_word_distance = known.max_word_distance if max_word_distance is None else max_word_distance

    def verdict(found: Column) -> Column:
        n, char, word = found["n_words"], found["char_distance"], found["word_distance"]
        failed = (n < min_words) | (100 * found["n_repeat_words"] > max_repeated_pct * n)
        char, word = F.when(found["word_chars"] >= char_guard, char), F.when(n >= word_guard, word)
        far = F.coalesce(char > max_char_distance, F.lit(False)) | F.coalesce(word > max_word_distance, F.lit(False))
        counts = [found[c].alias(c) for c in NAMES[:5]]
        return F.struct(*counts, failed.alias("base_failed"), char.alias("char_distance"), word.alias("word_distance"), (~failed & ~far).alias("kept"))

    text = F.coalesce(text, F.lit(""))
    return let(let(words_of(text), lambda w: _counts(text, w, known)), verdict)


def _counts(text: Column, words: Column, known: References) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        F.length(F.array_join(words, "")),
        lambda inside: F.struct(
            F.size(words).cast("long").alias("n_words"),
            inside.cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            _nearest(_character_histogram(text, inside), list(known.characters.values())).alias("char_distance"),
            let(words_of(_bare(text)), lambda bare: _word_distance(bare, known)).alias("word_distance"),
        ),
    )


def _repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more.

    Windows are compared by hash. Only a text with a repeated window is sorted, so that equal windows come together;
    each such window then adds the words up to the next one.
    """

    def of(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        gaps = let(starts, lambda s: F.transform(s, lambda at, i: F.least(F.lit(width), F.coalesce(F.get(s, i + 1) - at, F.lit(width)))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.aggregate(gaps, F.lit(0), lambda a, b: a + b))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda each: _windows(each, width))
    return F.when(F.size(words) <= width, 0).otherwise(let(hashed, of))


def _windows(each: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` values of a longer array, without a copy of each run."""
    hashes = F.transform(each, lambda x, i: F.xxhash64(x, *[F.get(each, i + k) for k in range(1, width)]))
    return F.slice(hashes, 1, F.size(each) - width + 1)


def _character_histogram(text: Column, inside: Column) -> Column:
    """Numbers of small letters, capitals, digits, spaces, punctuation marks and other characters."""

    def count(among: Column, pattern: str) -> Column:
        return F.length(among) - F.length(F.regexp_replace(among, pattern, ""))

    def of(rest: Column) -> Column:
        spaces, most = F.length(text) - inside, F.length(rest)
        named = F.array(count(rest, "\\p{Lu}+"), count(rest, "\\p{N}+"), spaces, count(rest, f"[{re.escape(PUNCTUATION)}]+"))
        return let(named, lambda k: F.concat(F.array(inside - most), k, F.array(most - k[0] - k[1] - k[3])))

    return let(F.regexp_replace(text, "[\\p{Ll}\\p{Lo}\\x20\\x09-\\x0D]+", ""), of)


def _bare(text: Column) -> Column:
    """Text in small letters (A-Z only) and without marks."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PUNCTUATION, "abcdefghijklmnopqrstuvwxyz")


def _word_distance(words: Column, known: References) -> Column:
    """Distance of the common words' counts, and of all other words', to the nearest language.

    Common words of a text are sorted and counted as runs. Those it lacks add their whole share to a language's divergence, so only words that are there are looked at.
    """
    every = sorted({w for shares in known.words.values() for w in shares})
    if not every:
        return F.lit(None).cast("double")

    def runs(found: Column) -> Column:
        last = F.filter(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].eqNullSafe(F.get(found, x["i"] + 1)))
        return let(last, lambda r: F.transform(r, lambda x, k: F.struct(x["w"].alias("w"), (x["i"] - F.coalesce(F.get(r, k - 1)["i"], F.lit(-1))).alias("n"))))

    def nearest(counts: Column, size: Column) -> Column:
        return F.array_min(F.array(*[_far(counts, size, shares) for shares in known.words.values()]))

    sorted_ = F.sort_array(F.filter(words, lambda w: w.isin(*every)))
    return let(let(sorted_, runs), lambda counts: let(F.size(words), lambda size: nearest(counts, size)))


def _far(counts: Column, size: Column, shares: dict[str, float]) -> Column:
    """Jensen-Shannon distance of a text's common words (w, n) among ``size`` words to a language."""
    given = F.map_from_arrays(F.array(*map(F.lit, shares)), F.array(*map(F.lit, shares.values())))
    named = F.transform(counts, lambda x: F.struct(x["n"].alias("n"), F.try_element_at(given, x["w"]).alias("q")))
    own = F.filter(named, lambda x: x["q"].isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("d"))

    def add(total: Column, x: Column) -> Column:
        return F.struct((total["n"] + x["n"]).alias("n"), (total["d"] + _part(x["n"] / F.greatest(size, F.lit(1)), x["q"]) - x["q"]).alias("d"))

    def whole(total: Column) -> Column:
        other = _part((size - total["n"]) / F.greatest(size, F.lit(1)), F.lit(1 - sum(shares.values())))
        return F.sqrt(F.greatest(F.lit(0.0), (total["d"] + sum(shares.values()) + other) / 2))

    return let(F.aggregate(own, start, add), whole)


def _nearest(histogram: Column, references: list) -> Column:
    if not references:
        return F.lit(None).cast("double")
    return let(histogram, lambda h: F.array_min(F.array(*[_distance(h, list(r)) for r in references])))


def _part(p: Column, q: Column) -> Column:
    """What a place of two distributions adds to twice their divergence."""
    mean = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0)


def _distance(histogram: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance: root of the divergence in bits of two distributions from their mean."""

    def of(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0), lambda a, b: a + b)
        given = F.array(*[F.lit(x) for x in reference])
        return let(
            F.greatest(total, F.lit(1)),
            lambda t: F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(h, given, lambda n, q: _part(n / t, q)), F.lit(0.0), lambda a, b: a + b) / 2)),
        )

    return let(histogram, of)
