"""Personal data by weak supervision, in DataFrame functions only.

Four regular expressions with their checks give the base kinds (email, ip,
card, phone), which always stay. Further candidates (secrets, numbers of card
length that fail the check digit, local phone numbers) are weaker. Labelers
vote -1, 0 or 1 on every candidate: the pattern and its check, gazetteers of
cue words and domain ends, and the characters and words around it.
Expectation-maximisation over the counts of the vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; with
these probabilities as soft targets a logistic span classifier is trained over
votes, kind and length. Weak candidates that it accepts become spans. Vote
patterns number a few hundred at most, whatever the corpus, so that estimation
runs over their counts on the driver.

Spans are (start, end) in code points, end exclusive. A text is cut at a
pattern's matches: the running sum of the lengths of pieces and matches gives
all positions, leftmost and non-overlapping per kind, matches that fail are
dropped. Running sums multiply their reach from step to step, so that a text with
100,000 addresses takes no more per address than another.

Cases: a null or empty text has no spans. Rows with equal doc_id are searched
each alone. Without any candidate nothing is trained and nothing is added; an
empty table gives an empty result. Very long texts are searched whole, in time
in proportion to their length (and the logarithm of their matches). find() reads
doc_id and text alone; redact() keeps all columns, those whose names clash with
its own too. Of spans that overlap, the one that starts first (then the longer,
then in the order of KINDS) gives the name in a redacted text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # SQL: whether a text may have any match
    check: str  # SQL over y.m, the match: whether it stands
    base: bool


_LOCAL = "A-Za-z0-9._%+-"
_DIGITS = "regexp_replace(y.m, '[^0-9]', '')"
# Luhn's sum from the right: each second digit doubled, less 9 beyond 9
_LUHN = f"""aggregate(transform(sequence(1, length({_DIGITS})), i ->
  transform(array(cast(substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1) as int) * (2 - i % 2)), d -> if(d > 9, d - 9, d))[0]), 0, (a, x) -> a + x) % 10 = 0"""
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# The patterns match what the plain forms match: possessive repeats and the look behind only keep long runs linear,
# since a match starts at the start of its run or where the match before ended (\\G).
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"t rlike '[0-9]\\.[0-9]'", rf"y.m rlike '^{_PART}(?:[.]{_PART}){{3}}$'", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"t rlike '[0-9](?:[\\x20-]?[0-9]){12}'", f"length({_DIGITS}) between 13 and 19 and {_LUHN}", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", f"length({_DIGITS}) between 9 and 15", True),
    Kind("number", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"t rlike '[0-9](?:[\\x20-]?[0-9]){12}'", f"length({_DIGITS}) between 13 and 19 and not ({_LUHN})", False),
    Kind("phone_local", r"(?<![0-9+] ?)\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])", "contains(t, '(')", "true", False),
    Kind("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,30}[0-9])[A-Za-z0-9]{32,}+", "t rlike '[A-Za-z0-9]{32}'", "y.m rlike '[A-Za-z]' and y.m rlike '[0-9]'", False),
)
CUES = "mail|e-mail|email|phone|tel|telephone|call|fax|card|visa|ccn|credit|token|key|secret|password|passwd|api|auth|ip|host|server|address|contact"
DOMAIN_ENDS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
LABELERS = ("pattern", "gazetteer", "context", "shape")
AROUND = 24
#: Steps of a running sum and the reach that each multiplies: 16^7 matches are more than a string holds.
STEPS, REACH = 7, 16
#: Code points of the blocks that a text is cut from.
BLOCK = 4096


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _votes(kind: Kind) -> str:
    """SQL for the labelers' votes on match y.m, with y.before and y.after, what stands around it."""
    pattern = "1" if kind.base else "-1" if kind.name == "number" else "0"
    cue = f"if(lower(y.before) rlike '(?:^|[^a-z])(?:{CUES})[^a-z]*$', 1, 0)"
    if kind.name == "email":
        cue = f"if(y.m rlike '[.](?:{DOMAIN_ENDS})$', 1, {cue})"
    context = "if(y.before = '' or right(y.before, 1) rlike '[^A-Za-z0-9_]', 1, -1) * if(y.after rlike '[A-Za-z0-9]', -1, 1)"
    shape = {
        "email": "if(length(y.m) between 6 and 64, 1, -1)",
        "ip": "if(y.m rlike '^(?:0|10|127|255)[.]' , -1, 1)",
        "card": "if(y.m rlike '^[3-6]', 1, 0)",
        "phone": "if(y.m rlike '[ ().-]', 1, 0)",
        "number": "if(y.m rlike '^[3-6]', 1, -1)",
        "phone_local": "1",
        "secret": "if(length(y.m) in (32, 40, 64), 1, 0)",
    }[kind.name]
    return f"array({pattern}, {cue}, {context}, {shape})"


def _running(values: str, merged: str = "x + {y}") -> str:
    """SQL for the array of running sums of an int array, or of what else merged says of x and an earlier y.

    Step k adds to each element those 1..REACH - 1 times REACH^k places before, as far as there are any.
    """
    for k in range(STEPS):
        far = REACH**k
        values = f"""transform(array({values}), a -> if(size(a) <= {far}, a, transform(a, (own, i) ->
          if(i < {far}, own, aggregate(sequence(1, least({REACH - 1}, cast(i div {far} as int))), own, (x, j) -> {merged.format(y=f"a[i - j * {far}]")})))))[0]"""
    return values


def _spans(kind: Kind) -> str:
    """SQL for the spans of one kind in text t: array of (kind, s, e, votes, long)."""
    p = _quoted(kind.pattern)
    type_ = "array<struct<kind:string,s:int,e:int,base:boolean,votes:array<int>,long:int>>"
    span = f"struct('{kind.name}' as kind, y.s as s, y.e as e, {str(kind.base).lower()} as base, {_votes(kind)} as votes, cast(least(9, floor(log2(y.e - y.s))) as int) as long)"
    # what stands before a match is the end of the piece before it, with the match before that piece
    match = f"""struct(m as m, ends[i] - length(m) as s, ends[i] as e,
      right(concat(coalesce(get(z.ms, i - 1), ''), z.gaps[i]), {AROUND}) as before, left(concat(z.gaps[i + 1], coalesce(get(z.ms, i + 1), '')), 1) as after)"""
    lengths = "zip_with(z.ms, slice(z.gaps, 1, size(z.ms)), (m, gap) -> length(m) + length(gap))"
    found = f"""transform(array(struct(regexp_extract_all(t, {p}, 0) as ms, split(t, {p}, -1) as gaps)), z ->
      transform(array({_running(lengths)}), ends -> transform(filter(transform(z.ms, (m, i) -> {match}), y -> {kind.check}), y -> {span}))[0])[0]"""
    return f"if({kind.gate}, cast({found} as {type_}), cast(array() as {type_}))"


def candidates(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, row, and cands: every candidate span with its votes."""
    texts = common.only(docs, "doc_id", "text").selectExpr("doc_id", "monotonically_increasing_id() as row", "coalesce(text, '') as t")
    return texts.select("doc_id", "row", F.expr("concat(" + ", ".join(map(_spans, kinds)) + ")").alias("cands"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """EM over (kind, votes, n): each kind has a prior, each labeler its rates of votes in both classes."""
    kinds = sorted({k for k, _, _ in patterns})
    prior = dict.fromkeys(kinds, 0.5)
    start = {-1: (0.15, 0.5), 0: (0.3, 0.3), 1: (0.55, 0.2)}
    rates = [{v: list(start[v]) for v in (-1, 0, 1)} for _ in LABELERS]
    soft: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, votes, _n in patterns:
            yes, no = prior[kind], 1 - prior[kind]
            for j, v in enumerate(votes):
                yes, no = yes * rates[j][v][0], no * rates[j][v][1]
            soft[kind, votes] = yes / (yes + no)
        for kind in kinds:
            mine = [(n, soft[k, v]) for k, v, n in patterns if k == kind]
            prior[kind] = min(0.98, max(0.02, (1 + sum(n * p for n, p in mine)) / (2 + sum(n for n, _ in mine))))
        for j in range(len(LABELERS)):
            totals = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for kind, votes, n in patterns:
                totals[votes[j]][0] += n * soft[kind, votes]
                totals[votes[j]][1] += n * (1 - soft[kind, votes])
            sums = [sum(t[c] for t in totals.values()) for c in (0, 1)]
            rates[j] = {v: [totals[v][c] / sums[c] for c in (0, 1)] for v in totals}
    return soft


def _features(kind: str, votes: tuple[int, ...], long: int) -> list[tuple]:
    return [("bias",), ("kind", kind), ("long", kind, long), *(("vote", j, v) for j, v in enumerate(votes))]


def train(groups: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 300, rate: float = 0.5) -> dict[tuple, float]:
    """A logistic classifier over (kind, votes, long, n) with the soft labels of estimate() as targets."""
    counts: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, votes, _, n in groups:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    soft = estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    total = sum(n for *_, n in groups)
    weights: dict[tuple, float] = {}
    for _ in range(rounds):
        slope: dict[tuple, float] = {}
        for kind, votes, long, n in groups:
            names = _features(kind, votes, long)
            p = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in names)))
            for f in names:
                slope[f] = slope.get(f, 0.0) + n / total * (p - soft[kind, votes])
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + 1e-4 * weights.get(f, 0.0))
    return weights


def accepted(found: DataFrame, threshold: float = 0.5) -> list[str]:
    """Trains on all candidates; the (kind, votes, long) that the classifier accepts, as text."""
    groups = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", "c.long").agg(F.count("*").alias("n")).collect()
    rows = sorted((g["kind"], tuple(g["votes"]), g["long"], g["n"]) for g in groups)
    weights = train(rows) if rows else {}
    return sorted({f"{k}:{','.join(map(str, v))}:{n}" for k, v, n, _ in rows if sum(weights[f] for f in _features(k, v, n)) >= math.log(threshold / (1 - threshold))})


def with_spans(found: DataFrame, names: list[str]) -> DataFrame:
    """candidates() with spans: base ones, and those whose (kind, votes, long) is accepted."""
    taken: Column = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")

    def stays(c: Column) -> Column:
        return c["base"] | F.array_contains(taken, F.concat_ws(":", c["kind"], F.array_join(F.transform(c["votes"], lambda v: v.cast("string")), ","), c["long"].cast("string")))

    return found.withColumn("spans", F.filter("cands", stays))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row and spans: array of (kind, s, e, base, votes, long), ordered by kind as in KINDS, then start."""
    found = common.stored(candidates(docs), "pii-candidates")
    return with_spans(found, accepted(found))


# A text in blocks, so that a piece of it is cut without a walk from the text's start.
_PIECE = f"""if(y.a div {BLOCK} = y.b div {BLOCK}, substr(coalesce(get(blocks, cast(y.a div {BLOCK} as int)), ''), y.a % {BLOCK} + 1, y.b - y.a),
  concat(substr(get(blocks, cast(y.a div {BLOCK} as int)), y.a % {BLOCK} + 1), array_join(slice(blocks, cast(y.a div {BLOCK} as int) + 2, cast(y.b div {BLOCK} - y.a div {BLOCK} as int) - 1), ''),
    substr(coalesce(get(blocks, cast(y.b div {BLOCK} as int)), ''), 1, y.b % {BLOCK})))"""
# A span starts a replaced stretch if it starts where all before it have ended (far: the farthest end up to each).
_REDACTED = f"""
transform(array(sort_array(transform(spans, (x, i) -> struct(x.s as s, -x.e as e, i as i, x.kind as kind)))), xs ->
  transform(array({_running("transform(xs, x -> -x.e)", "greatest(x, {y})")}), far ->
    transform(array(regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)), blocks ->
      concat(
        array_join(transform(filter(transform(xs, (x, i) -> struct(coalesce(get(far, i - 1), 0) as a, x.s as b, x.kind as kind)), y -> y.a <= y.b), y -> concat({_PIECE}, '[', upper(y.kind), ']')), ''),
        transform(array(struct(array_max(far) as a, {BLOCK} * size(blocks) as b)), y -> {_PIECE})[0]))[0])[0])[0]
"""


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars, where there is one, counted anew.

    Spans that overlap are replaced together, under the first one's kind. A null text stays null.
    """
    taken = accepted(candidates(docs))
    counted = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    docs, back = common.set_aside(docs, "t", "cands", "spans")
    spans = F.expr("concat(" + ", ".join(map(_spans, KINDS)) + ")")
    found = with_spans(docs.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("cands", spans), taken)
    out = found.withColumn("text", F.expr(f"if(size(spans) = 0, text, {_REDACTED})"))
    if counted is not None:
        out = out.withColumn("n_chars", F.length("text").cast(counted))
    return back(out)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text."""
    text = lambda xs: F.array_join(F.transform(xs, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])
    counts = [F.expr(f"cast(size(filter(spans, c -> c.kind = '{k.name}')) as bigint) as n_{k.name}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
