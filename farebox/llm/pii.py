"""Personal data by weak supervision, in DataFrame operations only.

Exact patterns find the base kinds: e-mail, IP address, card number and phone number.
Wider patterns propose further spans: long mixed strings (keys, tokens) and other groups of
digits. Six labelers vote on every span of either sort, for, against or not at all: the
shape, a gazetteer of words beside it, an assignment before it, its mixture of characters,
a checksum, and words that speak against it. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, and the probability of every
pattern. With those as soft labels a logistic model of the span itself and its context is
fitted; it decides about the proposed spans. Base spans always stay.

Only counts of vote and feature patterns come to the driver, at most 3^6 * 2^8 rows and a
few dozen in practice, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.staging import stage

# Each pattern starts at the start of a run, or where the last match ended (\G), and takes
# runs whole. That finds the leftmost matches and stays linear on long texts. Possessive
# groups are matched in a loop, so a long chain needs no deep stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# 14 to 19 digits from the start to the end of a sequence; longer sequences fail as a whole
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+"
NUMBER = r"(?<![A-Za-z0-9])[0-9(][0-9 ().-]{5,}+"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "number"]

# Words of the gazetteers.
FOR_WORDS = (
    "token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|"
    "phone|tel|telefon|teléfono|téléphone|mobile|handy|fax|call|ssn|iban|passport|account"
)
AGAINST_WORDS = "version|release|isbn|doi|page|figure|chapter|section|license|copyright|http|www"
LEFT, RIGHT = 24, 8
SPAN = "struct<start:int,end:int,kind:string,value:string,left:string,right:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    back = F.reverse(digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*([0-9]|[0-9]{2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _block_size(n: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints, all before it combined, from 0.

    Elements are taken in blocks as many as they are long, so that n of them cost n^1.5
    small steps: an array that grows by one element at a time would be copied n times.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), combine)

    def of(a: Column, size: Column) -> Column:
        blocks = _indexes(F.ceil(F.size(a) / size).cast("int"))
        block = lambda k: F.slice(a, k * size + 1, size)

        def inside(start: Column, part: Column) -> Column:
            return F.transform(
                _indexes(F.size(part)), lambda i: F.aggregate(F.slice(part, F.lit(1), i), start, combine)
            )

        return let(
            F.transform(blocks, lambda k: fold(block(k))),
            lambda totals: F.flatten(F.transform(
                blocks, lambda k: let(
                    fold(F.slice(totals, F.lit(1), k)), lambda start: let(block(k), lambda part: inside(start, part))
                ),
            )),
        )

    return let(values, lambda a: let(_block_size(F.size(a)), lambda size: of(a, size)))


def located(text: Column, pattern: str, kind: str) -> tuple[Column, Column, Callable[[Column, Column], Column]]:
    """Matches, the gaps between them, and a function of both that gives spans with code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(m: Column, g: Column) -> Column:
        each = _indexes(F.size(m))
        before = running(F.transform(each, lambda i: F.length(g[i]) + F.length(m[i])), lambda a, b: a + b)

        def span(begin: Column, i: Column) -> Column:
            return F.struct(
                begin.alias("start"), (begin + F.length(m[i])).alias("end"), F.lit(kind).alias("kind"),
                m[i].alias("value"), F.right(g[i], F.lit(LEFT)).alias("left"),
                F.left(g[i + 1], F.lit(RIGHT)).alias("right"),
            )

        return let(before, lambda b: F.transform(each, lambda i: span(b[i] + F.length(g[i]), i)))

    return found, gaps, spans


def meets(spans: Column, s: Column) -> Column:
    """Whether span ``s`` overlaps one of ``spans``, which are in order and apart, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        open_ = state["low"] < state["high"]
        left = open_ & (F.get(spans, middle)["start"] < s["end"])
        return F.struct(
            F.when(left, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~left, middle).otherwise(state["high"]).alias("high"),
        )

    # the last span that begins before s ends reaches furthest
    return F.aggregate(
        steps, start, step,
        lambda state: F.coalesce(F.get(spans, state["low"] - 1)["end"] > s["start"], F.lit(False)),
    )


def _trim(span: Column, keep: str) -> Column:
    """The span without trailing characters outside ``keep``."""
    value = F.regexp_replace(span["value"], f"[^{keep}]++$", "")
    return span.withField("value", value).withField("end", span["start"] + F.length(value))


def _digit_count(span: Column) -> Column:
    return F.length(digits(span["value"]))


def proposals(text: Column) -> dict[str, tuple[str, Column, Callable[[Column], Column]]]:
    """For each kind: pattern, what a text must have, and the test that a match must pass."""
    has = lambda p: text.rlike(p)
    return {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda s: F.lit(True)),
        "ip": (IP, has(r"[0-9]\.[0-9]++\.[0-9]"), lambda s: octets(s["value"])),
        "card": (CARD, has("[0-9][ -]?[0-9]"), lambda s: luhn(s["value"])),
        "phone": (PHONE, has(r"\+[0-9]"), lambda s: _digit_count(s).between(10, 15)),
        "secret": (SECRET, has("[0-9]"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")),
        "number": (NUMBER, has("[0-9][0-9 ().-]{5}"), lambda s: _digit_count(s).between(7, 20)),
    }


def labelers(s: Column) -> list[Column]:
    """Votes 1, 0 or -1 of each labeler on a span."""
    value, kind, left = s["value"], s["kind"], F.lower(s["left"])
    count = _digit_count(s)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    shape = (
        kind.isin(BASE)
        | value.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(AKIA|ghp_|sk[-_]|eyJ)[A-Za-z0-9_-]{12,})$")
        | value.rlike(r"^(\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    )
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return [
        vote(shape, F.length(value) > 80),
        vote(left.rlike(f"\\b({FOR_WORDS})\\b"), F.lit(False)),
        vote(left.rlike(r"""[:=]\s*["'(<]?$"""), left.rlike(r"[$€£#]\s*$")),
        vote((kind == "secret") & (distinct >= 10), (kind == "number") & (distinct <= 3)),
        vote(
            (kind == "card") | ((kind == "secret") & F.length(value).isin(32, 40, 64)),
            (kind == "number") & (count >= 13) & ~luhn(value),
        ),
        vote(F.lit(False), left.rlike(f"\\b({AGAINST_WORDS})\\b")),
    ]


def features(s: Column) -> list[Column]:
    """Bits that the span classifier sees."""
    value, left = s["value"], F.lower(s["left"])
    count = _digit_count(s)
    return [
        F.lit(True),
        s["kind"].isin(BASE),
        s["kind"] == "secret",
        left.rlike(f"\\b({FOR_WORDS})\\b"),
        left.rlike(r"""[:=]\s*["'(<]?$"""),
        left.rlike(f"\\b({AGAINST_WORDS})\\b"),
        F.length(value).between(32, 80),
        value.rlike("^[0-9a-f]+$") & (count < F.length(value)),
        value.rlike("[-(.]"),
    ]


def expectation_maximisation(
    counts: dict[tuple[int, ...], int], rounds: int = 60
) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Probability that each vote pattern is a real span, and each labeler's vote rates.

    Labelers are taken as independent given the truth. Rates start from the majority of
    votes, with one pseudo-count per vote, so an unused labeler stays neutral.
    """
    if not counts:
        return {}, []
    width = len(next(iter(counts)))
    chance = {p: 0.9 if sum(p) > 0 else 0.1 if sum(p) < 0 else 0.5 for p in counts}
    rates: list[dict] = []
    for _ in range(rounds):
        real = 1 + sum(n * chance[p] for p, n in counts.items())
        false = 1 + sum(n * (1 - chance[p]) for p, n in counts.items())
        rates = []
        for j in range(width):
            seen = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            for p, n in counts.items():
                seen[p[j], 1] += n * chance[p]
                seen[p[j], 0] += n * (1 - chance[p])
            rates.append({(v, y): x / ((real if y else false) + 2) for (v, y), x in seen.items()})
        for p in counts:
            odds = math.log(real / false)
            odds += sum(math.log(rates[j][v, 1] / rates[j][v, 0]) for j, v in enumerate(p))
            chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, rates


def fit_classifier(
    rows: list[tuple[tuple[bool, ...], float, int]], rounds: int = 400, penalty: float = 1e-3
) -> list[float]:
    """Logistic weights for (bits, soft label, count) rows, by gradient descent."""
    if not rows:
        return []
    width, total = len(rows[0][0]), sum(n for *_, n in rows)
    weights = [0.0] * width
    for _ in range(rounds):
        slope = [penalty * w for w in weights]
        for bits, label, n in rows:
            z = sum(w for w, b in zip(weights, bits) if b)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) * n / total
            for j, b in enumerate(bits):
                if b:
                    slope[j] += miss
        weights = [w - 2.0 * g for w, g in zip(weights, slope)]
    return weights


def candidate_spans(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_spans``: base spans, and proposed spans that overlap none of them."""
    whole = F.coalesce(docs[text], F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    folds, columns = {}, []
    for kind, (pattern, has, _) in proposals(whole).items():
        found, gaps, fold = located(whole, pattern, kind)
        columns += [F.when(has, found).alias(f"_m_{kind}"), F.when(has, gaps).alias(f"_g_{kind}")]
        folds[kind] = fold
    frame = docs.select(*(docs[c] for c in keep), *columns)
    tests = {kind: test for kind, (*_, test) in proposals(F.lit("")).items()}

    def spans_of(kind: str) -> Column:
        spans = folds[kind](F.col(f"_m_{kind}"), F.col(f"_g_{kind}"))
        if kind == "number":
            spans = F.transform(spans, lambda s: _trim(s, "0-9"))
        return F.when(F.col(f"_m_{kind}").isNotNull(), F.filter(spans, tests[kind])).otherwise(none)

    frame = frame.select(*keep, *(spans_of(kind).alias(f"_s_{kind}") for kind in KINDS))
    base = F.concat(*(F.col(f"_s_{kind}") for kind in BASE))
    more = F.concat(*(F.col(f"_s_{kind}") for kind in KINDS[len(BASE) :]))

    def free(s: Column) -> Column:
        return ~reduce(or_, (meets(F.col(f"_s_{kind}"), s) for kind in BASE))

    own = F.when(F.size(more) > 0, F.filter(more, free)).otherwise(none)
    return frame.select(*keep, F.concat(base, own).alias("_spans"))


def find_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and ``spans`` for every row of ``docs``.

    ``spans`` holds (start, end, kind, probability) by start, then kind in the order of
    ``KINDS``; offsets are code points, the end exclusive. A null or empty text has none.
    Base spans have probability 1. A column named ``spans`` gives way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "_spans")]
    found = stage(candidate_spans(docs, text, keep), "pii-candidates")
    s = F.col("s")
    votes = [v.alias(f"v{i}") for i, v in enumerate(labelers(s))]
    bits = [b.alias(f"f{i}") for i, b in enumerate(features(s))]
    rows = (
        found.select(F.explode("_spans").alias("s")).select(*votes, *bits)
        .groupBy(*(f"v{i}" for i in range(len(votes))), *(f"f{i}" for i in range(len(bits))))
        .count().collect()
    )
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        pattern = tuple(r[f"v{i}"] for i in range(len(votes)))
        counts[pattern] = counts.get(pattern, 0) + r["count"]
    chance, _ = expectation_maximisation(counts)
    weights = fit_classifier(sorted(
        (tuple(r[f"f{i}"] for i in range(len(bits))),
         chance[tuple(r[f"v{i}"] for i in range(len(votes)))], r["count"])
        for r in rows
    ))

    def scored(c: Column) -> Column:
        score = F.lit(0.0)
        for w, bit in zip(weights, features(c)):
            score = score + F.when(bit, F.lit(w)).otherwise(F.lit(0.0))
        sure = F.when(c["kind"].isin(BASE), 1.0).otherwise(F.round(1 / (1 + F.exp(-score)), 6))
        order = F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int")
        return F.struct(
            c["start"].alias("start"), order.alias("order"), c["end"].alias("end"),
            c["kind"].alias("kind"), sure.alias("probability"),
        )

    final = F.array_sort(F.filter(F.transform("_spans", scored), lambda x: x["probability"] >= 0.5))
    shown = F.transform(final, lambda x: F.struct(x["start"], x["end"], x["kind"], x["probability"]))
    shown = shown.cast("array<struct<start:int,end:int,kind:string,probability:double>>")
    return found.select(*keep, shown.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans merge."""

    def of(spans: Column, reached: Column, size: Column) -> Column:
        def part(k: Column) -> Column:
            """The text from where the spans before block ``k`` reach to where its own reach."""
            first, after = k * size, F.least((k + 1) * size, F.size(spans))
            begin = reached[first]
            end = F.coalesce(F.get(reached, after), F.greatest(reached[after - 1], spans[after - 1]["end"]))

            def piece(cut: Column, i: Column) -> Column:
                gap = F.substring(cut, reached[i] - begin + 1, spans[i]["start"] - reached[i])
                shown = F.concat(gap, F.lit("["), F.upper(spans[i]["kind"]), F.lit("]"))
                return F.when(spans[i]["start"] < reached[i], "").otherwise(shown)

            own = F.transform(_indexes(after - first), lambda j: j + first)
            return let(
                F.substring(text, begin + 1, end - begin),
                lambda cut: F.array_join(F.transform(own, lambda i: piece(cut, i)), ""),
            )

        blocks = _indexes(F.ceil(F.size(spans) / size).cast("int"))
        last = F.size(spans) - 1
        rest = F.substring(text, F.greatest(reached[last], spans[last]["end"]) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(blocks, part), ""), rest)

    reach = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    whole = let(spans, lambda s: let(reach(s), lambda r: let(_block_size(F.size(s)), lambda b: of(s, r, b))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
