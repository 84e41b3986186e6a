"""Quality rules by divergence from language references.

Every document has two histograms: classes of its characters, and its common words (one
bin for each common word of a language, one for all other words). The references are the
same histograms summed over all documents of a language that pass the base rules. A
document whose Jensen-Shannon distances to the nearest reference, both to the same one, are
too large is rejected. Too short documents have too rough a histogram and are not judged by
distance, nor are documents of a language that has no reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.text_arrays import SPACE, Hasher, Words, runs, slices
from farebox.staging import stage

# Common words of each language.
COMMON_WORDS = {
    "de": "der die das und in zu den mit von ist des sich auf für dem ein eine als auch nicht im",
    "en": "the of and to in that is was for it with as be by on not this are from at or an a he",
    "es": "de la que el en y a los se del las un por con una su para es al lo como más",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au aux il pas ne",
}
CHARACTER_CLASSES = ["lower", "upper", "digit", "sentence", "quote", "symbol", "control", "other"]
MIN_WORDS = 25
# A histogram of n words strays from its source by about n ** -0.5, so limits are a + b / sqrt(n).
CHARACTER_LIMIT = (0.14, 1.2)
WORD_LIMIT = (0.13, 1.8)
LANGUAGES = sorted(COMMON_WORDS)


def _character_classes() -> np.ndarray:
    """Class of each byte, and -1 for spaces and for bytes that continue a code point."""
    kind = np.full(256, 7)
    for b in range(128):
        c = chr(b)
        kind[b] = (
            -1 if SPACE[b] else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit()
            else 3 if c in ".,;:?!" else 4 if c in "'\"()-" else 6 if b < 32 or b == 127 else 5
        )
    kind[0x80:0xC0] = -1
    kind[0xC3:0xC5] = 0  # accented Latin letters count as lower-case letters
    return kind


_KIND = _character_classes()
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = np.arange(256) == 10
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    f"chars array<long>, {', '.join(f'words_{x} array<long>' for x in LANGUAGES)}"
)


def _common_hashes(language: str) -> np.ndarray:
    words = COMMON_WORDS[language].encode().split()
    data = np.frombuffer(b"".join(words), np.uint8)
    edges = np.cumsum([0, *map(len, words)])
    return Hasher(data, lower=True)(edges[:-1], edges[1:])


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def repeated(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(another with this key in this group?, an earlier one?) for each element."""
    order = np.lexsort((keys, groups))
    k, g = keys[order], groups[order]
    same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    any_, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    earlier[order[1:]] = same  # the sort is stable, so the first one stays unmarked
    return any_, earlier


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the histograms of the rows of one slice."""
    rows = len(offsets) - 1
    words = Words(data, offsets)
    row_of_word = np.repeat(np.arange(rows), np.diff(words.first))
    lowered = Hasher(data, lower=True)(words.starts, words.ends)
    inside = ~SPACE[data]
    out = {
        "n_words": np.diff(words.first),
        "word_chars": _sums(inside & ~_CONTINUES[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
    }
    line_starts, line_ends = runs(~_NEWLINE[data], offsets)
    line_words = np.searchsorted(words.starts, line_ends) - np.searchsorted(words.starts, line_starts)
    line_starts, line_ends = line_starts[line_words > 0], line_ends[line_words > 0]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    _, again = repeated(Hasher(data)(line_starts, line_ends), line_row)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)

    grams, whole = words.shingles(5)
    at = np.flatnonzero(whole)
    twice, _ = repeated(grams[at], row_of_word[at])
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(row_of_word[covered], minlength=rows)

    kind = _KIND[data]
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    bins = len(CHARACTER_CLASSES)
    counted = np.bincount(row_of_byte[kind >= 0] * bins + kind[kind >= 0], minlength=rows * bins)
    out["chars"] = counted.reshape(rows, bins)
    for language in LANGUAGES:
        common = _common_hashes(language)
        order = np.argsort(common)
        spot = np.minimum(np.searchsorted(common[order], lowered), len(common) - 1)
        found = common[order][spot] == lowered
        bin_of = np.where(found, order[spot], len(common))
        wide = len(common) + 1
        hist = np.bincount(row_of_word * wide + bin_of, minlength=rows * wide)
        out[f"words_{language}"] = hist.reshape(rows, wide)
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of each row of ``p`` to ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def text_measures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the measures of each text, one pass."""
    names = [part.split(" ")[0] for part in FEATURES.split(", ")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(len(keep))):
                found = measure(data, offsets)
                rows = len(offsets) - 1
                columns = [c.slice(first, rows) for c in batch.columns[: len(keep)]]
                for name in names:
                    v = found[name].astype(np.int64)
                    if v.ndim == 2:
                        edges = np.arange(rows + 1, dtype=np.int32) * v.shape[1]
                        columns.append(pa.ListArray.from_arrays(edges, v.ravel()))
                    else:
                        columns.append(pa.array(v))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def references(measured: DataFrame, lang: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(character histogram, word histogram) of each language, over all passing documents.

    One row of fixed width for each of the languages in ``COMMON_WORDS`` comes to the
    driver. A language without a passing document has no reference.
    """
    passing = measured.where(
        "n_words >= 10 and 100 * n_repeat_words <= 20 * n_words"
    ).where(F.col(lang).isin(LANGUAGES))
    sums = [
        F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CHARACTER_CLASSES))
    ] + [
        F.sum(F.col(f"words_{x}")[i]).alias(f"{x}{i}")
        for x in LANGUAGES
        for i in range(len(COMMON_WORDS[x].split()) + 1)
    ]
    found = {}
    for row in passing.groupBy(F.col(lang).alias("_lang")).agg(*sums).collect():
        x = row["_lang"]
        chars = np.array([row[f"c{i}"] for i in range(len(CHARACTER_CLASSES))], float)
        words = np.array([row[f"{x}{i}"] for i in range(len(COMMON_WORDS[x].split()) + 1)], float)
        found[x] = (chars, words)
    return found


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None,
    character_limit: tuple[float, float] = CHARACTER_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """``keep`` (default: all but the text), base counts, distances and ``kept`` for each row.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated
    five-word windows. Others with at least ``min_words`` words are kept if both distances
    to the nearest reference are within their limits; the nearest is the one whose limits
    the worse of both uses up least. Shorter ones are kept, and so are those whose ``lang``
    has no reference: no reference, no verdict, and null distances. A document of any
    referenced language, or of none (null), is held against all references, so a ``lang``
    that names the wrong one of them does it no harm. A null text is an empty one. Columns
    named like a result give way to it.
    """
    results = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "char_distance", "word_distance", "kept",
    ]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {*results, text}]
    docs, given = docs.withColumnsRenamed({c: f"__{c}" for c in keep}), keep
    keep, lang = [f"__{c}" for c in keep], f"__{lang}" if lang in keep else lang
    # one pass to measure, staged: the second pass needs the references of all documents
    inner = list(dict.fromkeys([*keep, lang]))
    measured = stage(text_measures(docs, text, inner), "quality-measures")
    known = references(measured, lang)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join(
        [f"`{c}` {kinds[c]}" for c in keep]
        + [f"{r} long" for r in results[:5]]
        + ["base_failed boolean, char_distance double, word_distance double, kept boolean"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            matrix = lambda c: batch.column(c).flatten().to_numpy().reshape(rows, -1)
            n = batch.column("n_words").to_numpy()
            spread = 1 / np.sqrt(np.maximum(n, 1))
            char_most = character_limit[0] + character_limit[1] * spread
            word_most = word_limit[0] + word_limit[1] * spread
            char, word, worse = (np.full(rows, np.inf) for _ in range(3))
            for x, (chars, words) in known.items():
                c, w = distance(matrix("chars"), chars), distance(matrix(f"words_{x}"), words)
                used = np.maximum(c / char_most, w / word_most)
                nearer = used < worse
                char, word = np.where(nearer, c, char), np.where(nearer, w, word)
                worse = np.minimum(used, worse)
            failed = base_failed(n, batch.column("n_repeat_words").to_numpy())
            referenced = np.array([x is None or x in known for x in batch.column(lang).to_pylist()], bool)
            judged = (n >= min_words) & referenced & bool(known)
            far = judged & (worse > 1)
            shown = [pa.array(np.where(judged, d, np.nan), mask=~judged) for d in (char, word)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in [*keep, *results[:5]]]
                + [pa.array(failed), *shown, pa.array(~failed & ~far)],
                names=[*keep, *results],
            )

    return measured.mapInArrow(run, schema).withColumnsRenamed(dict(zip(keep, given)))
