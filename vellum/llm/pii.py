"""Personal data and secrets: base patterns, wider candidates, boosted trees, calibrated thresholds.

Everything over documents is DataFrame functions, narrow from the scan to the result:
no shuffle, no Python on executors. Matches and the pieces between them come from
the same pattern (regexp_extract_all and split), so places are sums of lengths, and texts are cut
from parts of PART code points: all work is linear in a text and its spans.

Base spans (email, ip, card, phone) always stay. With them masked, wider patterns propose overlapping
spans of the same kinds and of secrets: spelled-out addresses, IPv6, numbers in odd
groups, national phone numbers, long runs of letters and digits. Each candidate has format and context features;
boosted trees, trained here on generated sentences, give a margin; the kind's threshold is
the least one that kept PRECISION on sentences whose wording the trees have not seen. Where chosen candidates
overlap, the one with the larger margin stays, then the next that overlaps none that stays, and so on;
of equal margins the first by start and kind.

Nulls: a null text is empty and has no spans. Repeated ids and rows are rows of their own, equal texts get equal
spans. Very long texts are searched whole. An empty table gives no rows. Extra columns are not read, whatever their
names; ``redact`` keeps them, and changes text alone.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import _shared, boosting

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MASK = "\ufdd0"  # a code point that is never a character
PRECISION = 0.98
CHUNK = 256
PART = 1024

# The base patterns with possessive repeats and a look-behind: no start inside a run that
# an earlier start has already tried, so long runs without a match stay linear.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "phone": "+"}
_DOT = r" ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?"


def _spelled(at: str) -> str:
    return rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{at}){_LABEL}{{1,63}}+(?:(?:{_DOT}|\.){_LABEL}{{1,63}}+){{1,5}}+"


# Several patterns of a kind may propose spans that overlap.
WIDE = {
    "email": (_spelled(r" ?(?:\[at\]|\(at\)|\{at\}) ?|@ | @ ?"), _spelled(" at ")),
    "ip": (r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",),
    "card": (r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{3,6}){2,4}+(?![0-9A-Za-z])",),
    "phone": (r"(?<![0-9A-Za-z+.])(?:(?:00|\+)[0-9]{1,3}[ ./-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}+(?![0-9A-Za-z])",),
    "secret": (r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,64}[0-9])(?=[0-9_+/-]{0,64}[A-Za-z])[A-Za-z0-9_+/-]{12,}+={0,2}",),
}
WORDS_NEAR = {
    "near_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|téléphone|appel|telefon|rufen|teléfono|llam)[^0-9]{0,16}$",
    "near_card": r"(?i)(?:card|visa|mastercard|amex|carte|karte|tarjeta|credit|debit)[^0-9]{0,16}$",
    "near_mail": r"(?i)(?:mail|contact|write|reach|courriel|correo|schreib)[^0-9]{0,16}$",
    "near_host": r"(?i)(?:ip|ipv6|host|server|address|addr|adresse|login)[^0-9]{0,16}$",
    "near_secret": r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|key|auth|bearer|credentials?|passphrase)[\"']?[ :=>]{1,4}[\"']?$",
    "assigned": r"[=:] {0,2}[\"']?$",
    "near_digest": r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|hash|uuid|guid|etag|build|id|file|image|path)[^0-9A-Za-z]{0,6}$",
    "near_other": r"(?i)(?:order|invoice|version|isbn|page|part|ref|serial|date|total|sku|ticket|bestell|commande|pedido|[#$€£=v])[^0-9]{0,6}$",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, plus: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Sums (or what plus makes, from 0 on) before each element. Worked out in chunks, as every append copies its array."""
    zero = F.lit(0).cast("long")
    chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
    part = lambda b: F.slice(values, b * CHUNK + 1, F.lit(CHUNK))
    push = lambda a, x: F.concat(a, F.array(plus(F.element_at(a, -1), x)))
    totals = F.transform(chunks, lambda b: F.aggregate(part(b), zero, plus))
    return let(
        F.aggregate(totals, F.array(zero), push),
        lambda before: F.flatten(F.transform(chunks, lambda b: F.slice(F.aggregate(part(b), F.array(before[b]), push), 1, CHUNK))),
    )


def _most(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in parts of PART."""
    first, last = F.floor(start / PART).cast("int"), F.floor((end - 1) / PART).cast("int")
    own, upto = (start % PART).cast("int") + 1, ((end - 1) % PART).cast("int") + 1
    several = F.concat(F.substr(parts[first], own), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substr(parts[last], F.lit(1), upto))
    return F.when(end <= start, F.lit("")).when(first == last, F.substr(parts[first], own, (end - start).cast("int"))).otherwise(several)


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column], over: Callable[[Column], Column] = lambda s: F.lit("")) -> Column:
    """text with mark(span) in place of each span; spans are by start, and one that overlaps those before it adds over(span)."""

    def build(x: Column) -> Column:
        parts, found, reached = x["parts"], x["spans"], x["reached"]
        kept = F.transform(
            found,
            lambda s, i: F.when(s["start"] >= reached[i], F.concat(_cut(parts, reached[i], s["start"]), mark(s))).otherwise(over(s)),
        )
        rest = F.greatest(F.element_at(reached, -1), F.element_at(found, -1)["end"])
        return F.concat(F.array_join(kept, ""), _cut(parts, rest, x["size"]))

    ends = F.transform(spans, lambda s: s["end"])
    bound = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"), spans.alias("spans"), _running(ends, _most).alias("reached"), F.length(text).cast("long").alias("size"))
    return F.when(F.size(spans) > 0, let(bound, build)).otherwise(text)


def _masks(s: Column) -> Column:
    """As many MASK signs as the span, or as what it adds to the spans before it, has code points."""
    return F.repeat(F.lit(MASK), F.greatest(s["fresh"], F.lit(0)).cast("int"))


MATCH = "array<struct<start: bigint, end: bigint, m: string, left: string, right: string>>"


def matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Every match with its place in code points and a little text on either side."""
    none = F.array().cast(MATCH)

    def placed(found: Column) -> Column:
        def rows(pieces: Column) -> Column:
            sizes = F.transform(found, lambda m, i: (F.length(pieces[i]) + F.length(m)).cast("long"))
            return let(
                _running(sizes),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (before[i] + F.length(pieces[i])).alias("start"),
                        (before[i] + F.length(pieces[i]) + F.length(m)).alias("end"),
                        m.alias("m"),
                        F.right(pieces[i], F.lit(28)).alias("left"),
                        F.left(pieces[i + 1], F.lit(12)).alias("right"),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), rows)).otherwise(none)

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(hint)), out).otherwise(none) if hint else out


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    size = F.length(number)

    def one(i: Column) -> Column:
        d = F.ascii(F.substr(number, size - i + 1, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: ~F.exists(F.split(m, r"\."), lambda p: ~F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))),
    "card": lambda m: let(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda s: VALID[kind](s["m"])


FEATURES = [
    "digits", "letters", "length", "signs", "groups", "longest_group", "shortest_group", "first_zero", "parens", "luhn", "brackets",
    "dots", "dashes", "spaces", "slashes", "open_left", "open_right", "distinct", "runs", "upper", "hexadecimal", *WORDS_NEAR,
]


def features(s: Column) -> list[Column]:
    """Format and context features of one candidate, as doubles, in the order of FEATURES."""
    m, count = s["m"], lambda p: F.length(F.regexp_replace(s["m"], p, ""))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    number = digits(m)
    out = [
        F.length(number), count("[^A-Za-z]"), F.length(m), count("[A-Za-z0-9]"), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.array_min(sizes), F.lit(0)), F.startswith(m, F.lit("0")), F.contains(m, F.lit("(")),
        F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False), F.rlike(m, F.lit(r"(?i)[\[({]at[\])}]")),
        count(r"[^.]"), count("[^-]"), count("[^ ]"), count("[^/]"), F.rlike(s["left"], F.lit("[0-9A-Za-z+/=#$€£-] ?$")), F.rlike(s["right"], F.lit("^ ?[0-9A-Za-z%°€$/=+-]")),
        F.size(F.array_distinct(F.split(m, ""))), F.length(F.regexp_replace(m, "[A-Za-z]+|[0-9]+", "x")), count("[^A-Z]"), F.rlike(m, F.lit("^[0-9a-fA-F]+$")),
        *[F.rlike(s["left"], F.lit(p)) for p in WORDS_NEAR.values()],
    ]
    return [c.cast("double") for c in out]


def with_spans(docs: DataFrame) -> DataFrame:
    """row (all of docs' columns), text, base and wide: structs of arrays of spans by kind."""
    row = F.struct(*[c.alias(n) for c, n in zip(_shared.own_columns(docs), docs.columns, strict=True)]).alias("row")
    out = docs.select(row, _shared.whole_text().alias("text"))
    out = out.withColumn("base", F.struct(*[F.filter(matches(F.col("text"), BASE[k], HINT.get(k)), _valid(k)).alias(k) for k in BASE_KINDS]))
    places = F.concat(*[F.transform(f"base.{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in BASE_KINDS])

    def fresh(found: Column) -> Column:
        """The spans with the number of code points that none before them has."""
        return let(
            F.struct(found.alias("spans"), _running(F.transform(found, lambda s: s["end"]), _most).alias("reached")),
            lambda x: F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["end"] - F.greatest(s["start"], x["reached"][i])).alias("fresh"))),
        )

    open_ = let(F.array_sort(places), lambda found: F.when(F.size(found) > 0, let(fresh(found), lambda spans: replaced(F.col("text"), spans, _masks, _masks))).otherwise(F.col("text")))
    out = out.withColumn("open", open_)
    numeric = F.rlike("open", F.lit("[0-9]{2}"))
    gates = {"email": F.rlike("open", F.lit(r"(?i)[\[({ ]at[\])} ]|@")), "ip": F.contains("open", F.lit(":")), "secret": F.rlike("open", F.lit("[0-9]"))}
    wide = [F.when(gates.get(k, numeric), F.concat(*[matches(F.col("open"), p) for p in WIDE[k]])).otherwise(F.array().cast(MATCH)).alias(k) for k in KINDS]
    return out.withColumn("wide", F.struct(*wide)).drop("open")


# Generated sentences: {x} is the marked string. Trees learn from the wordings of even places, thresholds from those of odd ones.
_LEADS = {
    "email": ["mail me at {x} please", "contact: {x}", "write to {x} today", "reach us {x} or come by", "the {x} of them", "send it to {x} soon"],
    "ip": ["the host {x} answered", "server {x} is down", "login from {x} today", "address {x} and port", "was {x} in the", "route to {x} lost"],
    "card": ["card {x} was charged", "paid with visa {x}", "carte {x} de", "tarjeta {x} que", "the {x} and", "credit {x} expired"],
    "phone": ["call {x} now", "tel. {x}", "phone: {x}", "téléphone {x} le", "Telefon {x} der", "llame al {x} y", "of {x} the", "mobile {x} or"],
    "secret": ['token = "{x}" and', "password: {x} for", "api_key={x} in", "secret = '{x}' de", "the auth {x} of", "export KEY={x} then", "Bearer {x} in", "passwd: {x} or"],
    "none": ["order {x} shipped", "invoice {x} total", "version {x} of it", "ISBN {x} page", "on {x} we met", "ref {x} and", "the {x} and of", "total = {x} units", "part {x} in", "file {x} was", "commit {x} by", "md5 {x} of", "build {x} ran", "id {x} is"],
}


def _numbers(rng: random.Random, *sizes: int) -> list[str]:
    return ["".join(rng.choice("0123456789") for _ in range(n)) for n in sizes]


def _card(rng: random.Random) -> str:
    body = [rng.randrange(10) for _ in range(15)]
    odd = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(body))
    return "".join(map(str, [*body, (10 - odd % 10) % 10]))


def _drawn(rng: random.Random, signs: str, n: int) -> str:
    return "".join(rng.choice(signs) for _ in range(n))


_HEX, _LETTERS, _DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _example(rng: random.Random, half: int) -> tuple[str, str, bool]:
    kind, good = rng.choice(KINDS), rng.random() < 0.5
    name = lambda: _drawn(rng, "abcdeimnorst", rng.randint(3, 8))
    sep = rng.choice([" ", ".", "-", "/"])
    leads = lambda k: rng.choice(_LEADS[k][half::2])
    if kind == "email":
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" @ ", ".")])
        x = f"{name()}{at}{name()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}" if good else rng.choice([f"{name()} at {name()}.{name().capitalize()}", f"{name()} at {name()}.{rng.randint(1, 99)}"])
    elif kind == "ip":
        x = ":".join(f"{rng.randrange(rng.choice([16, 4096, 65536])):x}" for _ in range(8)) if good else ":".join(_numbers(rng, *[2] * rng.choice([4, 5])))
    elif kind == "card":
        s = _card(rng)
        x = rng.choice(["  ", "/", ".", "_"]).join(s[k : k + 4] for k in range(0, 16, 4)) if good else sep.join(_numbers(rng, 4, rng.choice([3, 5]), 4, *[4] * rng.randint(0, 1)))
    elif kind == "secret" and good:
        mixed = _LETTERS + _LETTERS.upper() + _DIGITS
        x = rng.choice([_drawn(rng, _HEX, rng.choice([24, 32, 40, 64])), _drawn(rng, mixed, rng.randint(16, 48)), "AKIA" + _drawn(rng, _LETTERS.upper() + _DIGITS, 16), "sk-" + _drawn(rng, mixed, 40), "ghp_" + _drawn(rng, mixed, 36)])
        if not any(c.isdigit() for c in x[:60]):
            x = x[:4] + "7" + x[5:]
    elif kind == "secret":
        x = rng.choice([
            _drawn(rng, _HEX, rng.choice([32, 40])), "-".join(_drawn(rng, _HEX, n) for n in (8, 4, 4, 4, 12)), f"{name()}_{name()}_{rng.randint(1, 2030)}", f"{name()}-{name()}-{rng.randint(10, 9999)}",
            _drawn(rng, _DIGITS, rng.randint(12, 20)), f"{name()}/{name()}/{rng.randint(1, 999)}", f"{name()}{name()}{rng.randint(1, 9)}", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        ])
    elif good:
        x = rng.choice([
            "({}) {}-{}".format(*_numbers(rng, 3, 3, 4)), sep.join(_numbers(rng, 3, 3, 4)), "0" + sep.join(_numbers(rng, 1, 2, 2, 2, 2)),
            "+{} ({}) {}-{}".format(*_numbers(rng, 1, 3, 3, 4)), "0{}/{}".format(*_numbers(rng, 3, 5)), "0049 " + " ".join(_numbers(rng, 3, 4, 3)),
        ])
    else:
        x = rng.choice([
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "{} {}".format(*_numbers(rng, 2, 3)), "{}/{}".format(*_numbers(rng, 2, 4)),
            "{}.{}.{}".format(*_numbers(rng, 2, 2, 2)), "{}-{}-{}-{}".format(*_numbers(rng, 3, 2, 5, 2)), "{} {} {}".format(*_numbers(rng, 3, 3, 3)),
        ])
    around = lambda: " ".join(name() for _ in range(rng.randint(0, 4)))
    if x.startswith("+"):  # the numbers that follow hide it from the base pattern
        return f"{around()} {x} 190.137.223.204 {around()}", x, True
    # a secret without a word for it is one only by its form, so those stand behind their words here
    lead = leads(kind if good or (kind != "secret" and rng.random() < 0.2) else "none")
    return f"{around()} {lead.replace('{x}', x)} {around()}", x, good


def examples(n: int, seed: int = 7) -> list[tuple[int, str, int, int, bool]]:
    """(number, sentence, start and end of its marked string, whether that is personal data); every third has the other wordings."""
    rng, out = random.Random(seed), []
    for k in range(n):
        text, x, good = _example(rng, int(k % 3 == 0))
        at = text.index(x)
        out.append((k, text, at, at + len(x), good))
    return out


class Detector:
    def __init__(self, trees: dict[str, boosting.Trees], cut: dict[str, float]):
        self.trees, self.cut = trees, cut

    def margin(self, kind: str, s: Column) -> Column:
        return let(F.array(*features(s)), lambda f: self.trees[kind].column([f[k] for k in range(len(FEATURES))]))


def _featured(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*features(s)).alias("f"))


@lru_cache(maxsize=1)
def _training(spark: SparkSession, n: int):
    """Features of all wide candidates of n generated sentences, by kind."""
    rows = examples(n)
    found = with_spans(spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id long, text string"))
    out = {}
    for kind in KINDS:
        picked = found.select("row.doc_id", F.explode(F.transform(f"wide.{kind}", _featured)).alias("s"))
        out[kind] = sorted((r["doc_id"], r["s"]["start"], r["s"]["end"], tuple(r["s"]["f"])) for r in picked.collect())
    return rows, out


def fit(spark: SparkSession, n: int = 2400, precision: float = PRECISION) -> Detector:
    """Trees by kind from n generated sentences; the third of them that is worded otherwise sets the thresholds."""
    rows, found = _training(spark, n)
    trees, cut = {}, {}
    for kind, candidates in found.items():
        held = np.array([d % 3 == 0 for d, *_ in candidates], dtype=bool)
        x = np.array([f for *_, f in candidates], dtype=float).reshape(-1, len(FEATURES))
        y = np.array([float(rows[d][4] and a < rows[d][3] and b > rows[d][2] and (b - a) * 10 >= 7 * (rows[d][3] - rows[d][2])) for d, a, b, _ in candidates])
        trees[kind] = boosting.Trees(x[~held], y[~held])
        cut[kind] = boosting.calibrate(trees[kind].margins(x[held]), y[held], precision)
    return Detector(trees, cut)


SPAN = "array<struct<start: bigint, kind: int, end: bigint, margin: double>>"


def _span(kind: int, margin: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), margin(s).alias("margin"))


def _at_least(cut: float) -> Callable[[Column], Column]:
    return lambda s: s["margin"] >= cut - 1e-9  # sums in another order


def _apart(added: Column) -> Column:
    """Of spans by start and kind those that stay: the largest margin first, then each that overlaps none that stays.

    Only spans that overlaps connect are compared: these are runs, as each begins before the furthest end so far.
    """

    def fewer(run: Column) -> Column:
        ranked = F.array_sort(F.transform(run, lambda s: F.struct((-s["margin"]).alias("order"), s.alias("s"))))
        meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
        take = lambda acc, x: F.when(F.exists(acc, lambda k: meets(k, x["s"])), acc).otherwise(F.concat(acc, F.array(x["s"])))
        return F.when(F.size(run) < 2, run).otherwise(F.aggregate(ranked, F.array().cast(SPAN), take))

    def runs(x: Column) -> Column:
        found, first = x["spans"], x["first"]
        upto = lambda i: F.coalesce(F.get(first, i + 1), F.size(found))
        return F.flatten(F.transform(first, lambda at, i: fewer(F.slice(found, at + 1, upto(i) - at))))

    def starts(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(x["spans"]) - 1)
        first = F.filter(places, lambda i: (i == 0) | (x["spans"][i]["start"] >= x["reached"][i]))
        return let(F.struct(x["spans"].alias("spans"), first.alias("first")), runs)

    bound = F.struct(added.alias("spans"), _running(F.transform(added, lambda s: s["end"]), _most).alias("reached"))
    return F.when(F.size(added) > 1, let(bound, starts)).otherwise(added)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """row, text, base (by kind) as with_spans has them, and found and spans: base spans and all spans by start, then kind."""
    out = with_spans(docs)
    base = F.concat(*[F.transform(f"base.{k}", _span(n, lambda s: F.lit(float("inf")))) for n, k in enumerate(BASE_KINDS)])
    added = []
    for n, k in enumerate(KINDS):
        scored = F.transform(f"wide.{k}", _span(n, partial(detector.margin, k)))
        chosen = F.filter(scored, _at_least(detector.cut[k]))
        added.append(F.when(F.size(f"wide.{k}") > 0, chosen).otherwise(F.array().cast(SPAN)))
    out = out.withColumn("found", F.array_sort(base).cast(SPAN))
    every = let(F.array_sort(F.concat(*added)).cast(SPAN), lambda more: F.when(F.size(more) > 0, F.array_sort(F.concat("found", _apart(more)))).otherwise(F.col("found")))
    return out.withColumn("spans", every)


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs, columns as they are, with every span in text replaced by its kind in brackets; overlapping spans become one."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = detect(docs, detector)
    done = F.when(F.size("spans") > 0, let(F.col("spans"), lambda spans: replaced(F.col("text"), spans, lambda s: marks[s["kind"]]))).otherwise(F.col("row")["text"])
    return found.select(*[(done if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, fit(spark)).select(
        "row.doc_id",
        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_written("found").cast("binary"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
    )
