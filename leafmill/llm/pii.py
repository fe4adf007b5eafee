"""Personal data by weak supervision, with DataFrame functions only.

Base spans are exact regular expressions with checks (emails, IPv4 addresses,
card numbers with Luhn digits, phone numbers with a plus). Wider patterns give
more candidates: written-out emails, IPv6 addresses, phone numbers without a
plus, long numbers that fail Luhn. Five labelers vote on every candidate, base
or not, with 1, -1 or 0: the strict form, the number's structure, a gazetteer
(top-level domains, country calling codes, card issuer prefixes, reserved
addresses), words before the span, and the characters around it.

Counts of vote patterns over all documents (at most 4 x 3^5 rows times the
length and digit classes) go to the driver, where expectation-maximisation
estimates each labeler's reliability for each hidden class; its posteriors
train a logistic classifier of spans over kind, votes, length and digits. The
classifier is applied as a column expression: candidates it accepts that touch
no base span are added; base spans always stay.

Positions are code points, end exclusive. They come from the lengths of the
pieces between matches, by sums over blocks of BLOCK and blocks of those; words
before a span and characters around it come from the pieces too, so the text
itself isn't searched again for each span. Whether a wider candidate touches a
base span is found by halving. So a text with very many matches takes time in
proportion to them, but for a factor of about BLOCK. Patterns use possessive
loops and start only where a run starts or the last match ended, which keeps
the leftmost matches and takes linear time on long runs.

A null text counts as empty: no spans. Repeated rows give repeated rows; a
null doc_id is a key like any other; extra columns are not read; with no
candidate at all nothing is trained and no span is added.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
BLOCK = 64
#: Characters before a span that the context labeler reads, back to the match before it at most.
CONTEXT = 40

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
#: What must be in a text for a pattern to match, and the pattern. Base patterns by kind, then wider ones.
BASE = (
    ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++"),
    ("[0-9]\\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9]){11,}+"),
    ("\\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
_AT, _DOT = r"(?:[ ]?[(\[]at[)\]][ ]?|[ ]at[ ])", r"(?:[ ]?[(\[]dot[)\]][ ]?|[ ]dot[ ])"
WIDE = (
    ("[ (\\[]dot[ )\\]]", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++{_AT}{_LABEL}(?:{_DOT}{_LABEL})++"),
    ("[0-9a-fA-F]:[0-9a-fA-F]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9]){12,}+"),
    ("[0-9]{3}[-. ][0-9]{4}", r"(?<![0-9+])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
)

#: Gazetteers.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|nl|uk|eu|us|ca|au|ch|at|be|pl|se|no|dk|fi|pt|br|mx|ar|cl|ru|jp|cn|in"
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1368]|2[2-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[4-7]|6011|64[4-9]|65|62"
RESERVED = r"(?:0|127|22[4-9]|2[345][0-9])\."
WORDS_FOR = (
    "mail|contact|write|schreib|escrib|correo|courriel",
    r"\bip\b|host|addr|server|ping|client|adres",
    "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    r"\btel|phone|call|fax|mobil|cell|anruf|appel|llam",
)
WORDS_AGAINST = "version|isbn|issn|order|invoice|ticket|serial|token|sha|md5|uuid|build|release"


def _let(x: Column, f) -> Column:
    """f(x), where x is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _scan(values: Column, zero: Column, op) -> Column:
    """For each entry of an array the entries before it, put together by op."""
    fold = lambda x: F.aggregate(x, zero, op)
    upto = lambda v: F.sequence(F.lit(0), F.size(v) - 1)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = lambda v: F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    inside = lambda v, i: fold(F.slice(v, block(i) * BLOCK + 1, i % BLOCK))

    def of(v):
        def by_block(s):
            starts = _let(sums(s), lambda s2: F.transform(upto(s), lambda b: op(fold(F.slice(s2, F.lit(1), block(b))), inside(s, b))))
            return _let(starts, lambda o: F.transform(upto(v), lambda i: op(F.element_at(o, block(i) + 1), inside(v, i))))

        return F.when(F.size(v) > 0, _let(sums(v), by_block)).otherwise(F.array().cast("array<int>"))

    return _let(values, of)


def _below(sorted_values: Column, limit: Column) -> Column:
    """How many entries of a sorted array are below limit."""
    n = F.size(sorted_values)
    step = lambda at, k: F.when((at + k <= n) & (F.get(sorted_values, at + k - 1) < limit), at + k).otherwise(at)
    return F.aggregate(F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int")), F.lit(0), step)


_MATCH = "array<struct<start:int,m:string,before:string,left:string,right:string>>"


def _matches(df: DataFrame, patterns, at: str) -> DataFrame:
    """df with arrays {at}0, {at}1, ... of structs (start, m, before, left, right), one for each pattern, over __text."""
    text = F.col("__text")
    names = [f"{at}{k}" for k in range(len(patterns))]
    none = F.array().cast("array<string>")
    has = {f"__has_{n}": text.contains(need) if need == "@" else text.rlike(need) for n, (need, _) in zip(names, patterns, strict=True)}
    df = df.withColumns(has)
    df = df.withColumns({f"__m_{n}": F.when(F.col(f"__has_{n}"), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(none) for n, (_, p) in zip(names, patterns, strict=True)})
    df = df.withColumns({f"__p_{n}": F.when(F.size(f"__m_{n}") > 0, F.split("__text", p, -1)).otherwise(none) for n, (_, p) in zip(names, patterns, strict=True)})

    def spans(n):
        def of(both):
            m, p = both["m"], both["p"]
            lengths = F.transform(m, lambda x, i: F.char_length(F.get(p, i)) + F.char_length(x))
            # the character of the piece, or of the match that lies right beside
            beside = lambda piece, end, other: F.when(F.length(piece) > 0, end(piece)).otherwise(F.coalesce(end(other), F.lit(" ")))
            last, first = (lambda x: F.right(x, F.lit(1))), (lambda x: F.left(x, F.lit(1)))

            def one(x, i, before):
                piece = F.get(p, i)
                return F.struct(
                    (F.get(before, i) + F.char_length(piece)).alias("start"),
                    x.alias("m"),
                    F.lower(F.right(piece, F.lit(CONTEXT))).alias("before"),
                    beside(piece, last, F.when(i > 0, F.get(m, i - 1))).alias("left"),
                    beside(F.get(p, i + 1), first, F.get(m, i + 1)).alias("right"),
                )

            return _let(_scan(lengths, F.lit(0), lambda a, b: a + b), lambda before: F.transform(m, lambda x, i: one(x, i, before)))

        return F.when(F.size(f"__m_{n}") > 0, _let(F.struct(F.col(f"__m_{n}").alias("m"), F.col(f"__p_{n}").alias("p")), of)).otherwise(F.array().cast(_MATCH))

    return df.withColumns({n: spans(n) for n in names}).drop(*[f"__{c}_{n}" for c in ("has", "m", "p") for n in names])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, digit(i)).otherwise(twice(digit(i)))) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return ~F.exists(F.split(m, r"\."), lambda x: (F.length(x) > 3) & (F.length(F.ltrim(x, F.lit("0"))) > 3) | (F.substring(F.concat(F.lit("000"), F.ltrim(x, F.lit("0"))), -3, 3) > "255"))
    n = F.length(_digits(m))
    if kind == 2:
        return F.when((n >= 12) & (n <= 19), luhn(_digits(m))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _structure(kind: int, base: bool, m: Column) -> Column:
    n = F.length(_digits(m))
    vote = lambda good: F.when(good, 1).otherwise(-1)
    if kind == 0:
        return vote(F.length(m).between(6, 254))
    if kind == 1:
        return F.lit(1) if base else vote(m.rlike("[a-fA-F]"))
    if kind == 2:
        return F.lit(1) if base else vote(n.between(13, 16) & m.rlike("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"))
    return vote(n.between(10, 13))


def _gazetteer(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.when(F.lower(m).rlike(rf"(?:\.| |\)|\])(?:{TOP_DOMAINS})$"), 1).otherwise(0)
    if kind == 1:
        return F.when(m.rlike(f"^{RESERVED}"), -1).otherwise(1)
    if kind == 2:
        return F.when(_digits(m).rlike(f"^(?:{ISSUERS})"), 1).otherwise(-1)
    return F.when(m.rlike(rf"^\+(?:{CALLING_CODES})"), 1).when(m.startswith("+"), -1).otherwise(0)


def _candidates(spans: Column, kind: int, base: bool) -> Column:
    def one(s):
        m, start, before, left, right = s["m"], s["start"], s["before"], s["left"], s["right"]
        end = start + F.char_length(m)
        n = F.length(_digits(m))
        return F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            F.lit(base).alias("base"),
            F.lit(1 if base else -1).alias("v0"),
            _structure(kind, base, m).alias("v1"),
            _gazetteer(kind, m).alias("v2"),
            F.when(before.rlike(WORDS_FOR[kind]), 1).when(before.rlike(WORDS_AGAINST), -1).otherwise(0).alias("v3"),
            F.when(left.rlike(r"[\p{L}\p{N}_=/]") | right.rlike(r"[\p{L}\p{N}_=/]"), -1).otherwise(1).alias("v4"),
            F.least(F.floor(F.char_length(m) / 8), F.lit(4)).cast("int").alias("length"),
            F.least(F.floor(n / 5), F.lit(4)).cast("int").alias("digits"),
        )

    kept = F.filter(spans, lambda s: _valid(kind, s["m"])) if base else spans
    return F.transform(kept, one)


FEATURES = ("kind", "v0", "v1", "v2", "v3", "v4", "length", "digits")


def candidates(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and cands, an array of structs: every base span, and every wider candidate that touches none."""
    rows = df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = _matches(_matches(rows, BASE, "__base"), WIDE, "__wide")
    flat = lambda at, base: F.flatten(F.array(*[_candidates(F.col(f"{at}{k}"), k, base) for k in range(4)]))
    rows = rows.withColumn("__b", flat("__base", True)).withColumn("__w", flat("__wide", False))

    def free(base):
        """The wider candidates that touch none of the base spans: those that start before its end all end by its start."""
        ends = F.concat(F.transform(base, lambda b: b["end"]), F.array(F.lit(0)))
        far = _scan(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        bounds = F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), far.alias("far"))
        return _let(bounds, lambda x: F.filter("__w", lambda w: F.get(x["far"], _below(x["starts"], w["end"])) <= w["start"]))

    kept = F.when((F.size("__w") > 0) & (F.size("__b") > 0), _let(F.array_sort(F.transform("__b", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))), free)).otherwise(F.col("__w"))
    return rows.select(*keys, F.concat("__b", kept).alias("cands"))


def estimate(patterns: list[tuple], rounds: int = 60) -> tuple[list[float], list]:
    """Expectation-maximisation over (kind, votes..., n): posteriors of the patterns, and each labeler's reliability.

    patterns: tuples (kind, (v0, ...), n). Reliability: P(vote | class) for each labeler, class 0 and 1.
    """
    voters = len(patterns[0][1])
    prior = {k: 0.5 for k, _, _ in patterns}
    table = [[{1: 0.1, 0: 0.4, -1: 0.5}, {1: 0.5, 0: 0.4, -1: 0.1}] for _ in range(voters)]
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for x, (k, votes, _) in enumerate(patterns):
            a, b = math.log(1 - prior[k]), math.log(prior[k])
            for v, t in zip(votes, table, strict=True):
                a, b = a + math.log(t[0][v]), b + math.log(t[1][v])
            post[x] = 1 / (1 + math.exp(min(700, max(-700, a - b))))
        for k in prior:
            own = [(p, n) for p, (kk, _, n) in zip(post, patterns, strict=True) if kk == k]
            prior[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for i, t in enumerate(table):
            for c in (0, 1):
                weight = {v: 0.5 for v in (-1, 0, 1)}
                for p, (_, votes, n) in zip(post, patterns, strict=True):
                    weight[votes[i]] += n * (p if c else 1 - p)
                t[c] = {v: w / sum(weight.values()) for v, w in weight.items()}
    return post, table


def train(rows: list[tuple[tuple, float, int]], rounds: int = 300, ridge: float = 1e-3) -> dict[tuple[int, int], float]:
    """Logistic weights for (feature index, value) from (feature values, soft label, count); (-1, 0) is the constant."""
    weights: dict[tuple[int, int], float] = {(-1, 0): 0.0}
    for values, _, _ in rows:
        weights.update({(i, v): 0.0 for i, v in enumerate(values)})
    total = sum(n for _, _, n in rows)
    step = 4.0 / (len(FEATURES) + 1)  # below two over the largest curvature
    for _ in range(rounds):
        grad = {k: ridge * w for k, w in weights.items()}
        for values, y, n in rows:
            at = [(-1, 0), *enumerate(values)]
            z = sum(weights[k] for k in at)
            g = (1 / (1 + math.exp(-max(-60, min(60, z)))) - y) * n / total
            for k in at:
                grad[k] += g
        weights = {k: w - step * grad[k] for k, w in weights.items()}
    return weights


def fit(cands: DataFrame) -> dict[tuple[int, int], float]:
    """Weights of the span classifier, learnt from all candidates; {} if there are none."""
    spans = cands.select(F.explode("cands").alias("c")).select("c.*")
    # at most 4 * 3^5 * 25 rows, for any input
    counts = spans.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    counts.sort(key=lambda r: tuple(r[f] for f in FEATURES))
    patterns = [(r.kind, (r.v0, r.v1, r.v2, r.v3, r.v4), r.n) for r in counts]
    post, _ = estimate(patterns)
    return train([(tuple(r[f] for f in FEATURES), p, r.n) for r, p in zip(counts, post, strict=True)])


def _score(c: Column, weights: dict[tuple[int, int], float]) -> Column:
    parts = [F.lit(weights[-1, 0])]
    for i, f in enumerate(FEATURES):
        cases = [(v, w) for (j, v), w in sorted(weights.items()) if j == i]
        parts.append(reduce(lambda e, x: e.when(c[f] == x[0], x[1]), cases[1:], F.when(c[f] == cases[0][0], cases[0][1])).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts)


def personal_data(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, base_spans and all_spans: arrays of (start, kind, end) by start, then kind."""
    cands = written(candidates(df, keys, text), "spans")
    weights = fit(cands)
    accepted = (lambda c: c["base"] | (_score(c, weights) >= 0)) if weights else (lambda c: c["base"])
    plain = lambda x: F.array_sort(F.transform(x, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return cands.select(*keys, plain(F.filter("cands", lambda c: c["base"])).alias("base_spans"), plain(F.filter("cands", accepted)).alias("all_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
