"""Operator 6: personal data by weak-supervision aggregation, in DataFrame functions only.

Candidates are (1) the matches of the base patterns that pass their check, which are spans whatever follows, (2) those
that fail it, and (3) the matches of wider patterns: addresses with "(at)" and "dot" spelled out, IPv6 addresses,
numbers of 12 to 19 digits, national telephone numbers of several countries, and secrets (values assigned to a key, and
bare keys of mixed letters and digits). On every candidate five labelers vote yes (1), no (-1) or nothing (0); none of
them is the base pattern, and they differ on candidates of either sort:

    check      what the kind can prove: Luhn sum, parts of an address, number of digits, mixture of a secret's characters
    gazetteer  top-level domains, calling and area codes, card issuers, unusable IP ranges, names of keys
    context    key words among the characters before, for and against
    shape      what stands on either side: white space and marks, or letters and digits of a larger token
    form       how it is written: usual groups, or a bare run

Expectation-maximisation over the counts of vote patterns (two hidden classes for each kind, labelers
independent given the class) estimates every labeler's reliability; the resulting posteriors are the
targets of a logistic span classifier over votes and span features. Both work on counts of distinct
feature cells (at most 5 x 3^5 x 3 x 2 rows, the only thing that comes to the driver). A candidate that is no base
span is a span if the classifier gives it at least THRESHOLD and it touches no base span and no accepted one before it.

All work on a text happens in its own row: no shuffle but that of the cell counts. A very long text is scanned
whole; patterns don't backtrack, so time is linear in its length, and memory in it and its number of candidates.

Defined cases: null text counts as empty (no spans); null and repeated doc_id stay, one row each; candidates that
start alike are taken in the order of KINDS, then the longer one; an empty table gives no rows and an untrained
classifier (base spans only); extra columns, whatever they are called, are ignored by `find` and kept by `mask`.
Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, only, table

#: The four kinds of the contract, then what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
THRESHOLD = 0.5
LOCAL, NEAR = "A-Za-z0-9._%+-", 24
#: The base patterns, written so that no start is tried twice within a run and no group backtracks: a start
#: is where a run of the first class begins or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns; what they share with base spans is dropped.
WIDE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?(?:\(at\)|\[at\]|\{{at\}}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}}|\x20dot\x20)\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+.(/-])(?:\([0-9]{2,5}\)[\x20-]?|0[0-9]{1,4}[\x20/.-]|[0-9]{3}[\x20.-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}+(?![0-9./-])",
    "secret": r"(?i)(?<![A-Za-z0-9_])(?:[a-z0-9_-]{0,24}(?:token|secret|passw(?:or)?d|passwd|pwd|api_?-?key|access_?-?key|auth|credential|sessionid|clave|kennwort|passwort|motdepasse)[a-z0-9_-]{0,24}+\x20?[:=]\x20?\"?[^\s\",;]{6,}+|[A-Za-z0-9+/_=-]{24,}+)",
}
#: Domains, calling and area codes, issuers' first digits, names of keys, and key words for and against.
DOMAINS = "com|org|net|edu|gov|io|info|biz|dev|app|de|fr|es|it|uk|eu|ch|at|be|nl|pt|pl|cz|se|no|dk|fi|ie|us|ca|mx|ar|co|br|au|nz|jp|cn|in|ru"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|212|213|216|218|351|352|353|354|355|356|357|358|359|370|371|372|380|385|386|420|421"
AREA = "0[1-9]|[2-9][0-9]{2}"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6"
NAMED = "token|secret|passw|passwd|pwd|key|auth|credential|sessionid|clave|kennwort|passwort|motdepasse"
FOR = {"email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|host|server|addr", "card": "card|visa|master|pay|karte|carte|tarjeta", "phone": "phone|call|tel|fax|mobil|handy|appel|llam", "secret": "key|token|auth|login|bearer|secret"}
AGAINST = {"email": "git|version", "ip": "version|release|section", "card": "isbn|sha|order|serial|invoice|version", "phone": "isbn|version|date|order|page", "secret": "http|www|sha256|md5|commit|file|path"}
LABELERS = ("check", "gazetteer", "context", "shape", "form")
SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places: the pieces between them give the offsets."""

    def placed(ms: Column) -> Column:
        def at(pieces: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                m = F.get(ms, i)
                s = acc["pos"] + F.length(F.get(pieces, i))
                one = F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(F.get(pieces, i), F.lit(NEAR)).alias("b"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("a"))
                return F.struct((s + F.length(m)).alias("pos"), F.concat(acc["out"], F.array(one).cast(f"array<{SPAN}>")).alias("out"))

            start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), start, step, lambda acc: acc["out"])

        return F.when(F.size(ms) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(F.split(text, pattern, -1), at))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    odd = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: odd(F.when(c == "", "0").otherwise(c), i)), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 4) & (F.when(F.length(x).between(1, 3), x.cast("int")).otherwise(0) < 256))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    return F.length(_digits(m)).between(9, 15)


def _votes(kind: str, x: Column, base: Column) -> Column:
    """The span with its votes; features that the classifier takes besides: size, and whether it has separators."""
    m, near, after = x["m"], F.lower(x["b"]), x["a"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    digits = _digits(m)
    value = F.regexp_replace(m, r"^[^:=]*[:=]\x20?\"?", "")
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
    check = {
        "email": lambda: vote(m.rlike(r"(?i)[a-z][a-z0-9._%+-]*[^a-z0-9].*[a-z]{2,}$"), m.rlike(r"[0-9]$")),
        "ip": lambda: vote(m.contains(":") | valid("ip", m), F.lit(True)),
        "card": lambda: let(digits, lambda d: vote(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False), F.lit(True))),
        "phone": lambda: vote(F.length(digits).between(9, 15), ~F.length(digits).between(7, 15)),
        "secret": lambda: vote(mixed & (F.length(value) >= 16), ~mixed | (F.length(value) < 8)),
    }[kind]()
    gazetteer = {
        "email": lambda: vote(F.lower(m).rlike(rf"[.\])}}\x20]({DOMAINS})$"), F.lit(True)),
        "ip": lambda: vote(F.lit(False), m.rlike(r"^0*(0|127|22[4-9]|2[3-5][0-9])\.")),
        "card": lambda: vote(digits.rlike(f"^({ISSUERS})"), F.lit(True)),
        "phone": lambda: vote(m.rlike(rf"^\+({CALLING})(?![0-9]*$)|^\+({CALLING})[0-9]*$|^\(?({AREA})"), F.lit(True)),
        "secret": lambda: vote(F.lower(m).rlike(rf"^[a-z0-9_-]*({NAMED})[a-z0-9_-]*\x20?[:=]"), F.lit(False)),
    }[kind]()
    context = vote(near.rlike(FOR[kind]), near.rlike(AGAINST[kind]))
    shape = vote(~near.rlike(r"[\p{L}0-9=#/]$") & ~after.rlike(r"^[\p{L}0-9=#/@]"), F.lit(True))
    form = {
        "email": lambda: vote(m.rlike(r"^[A-Za-z0-9._%+-]{2,64}[@\x20(\[{]"), F.lit(True)),
        "ip": lambda: vote(m.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|:"), F.lit(True)),
        "card": lambda: vote(m.rlike(r"^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), ~m.rlike(r"^[0-9]+$")),
        "phone": lambda: vote(m.rlike(r"^\+[0-9]{1,3}[\x20.-]|^\([0-9]+\)|^0[0-9]+/"), m.rlike(r"^[0-9]{3}\x20[0-9]{3}\x20[0-9]{3}$|^[0-9+]+$")),
        "secret": lambda: vote(F.lower(value).rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | m.contains('"'), value.rlike("^[A-Za-z_-]+$|^[0-9_=-]+$")),
    }[kind]()
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), check.alias("check"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), form.alias("form"),
                    F.when(F.length(m) < 12, 0).when(F.length(m) < 18, 1).otherwise(2).alias("size"), m.rlike(r"[\x20()\[\]-]").alias("spaced"))


def candidates(text: Column) -> Column:
    """array of spans with their votes: the base ones, and the others that touch no base span."""
    none = F.array().cast(f"array<{SPAN}>")
    could = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike("[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    may = {
        "email": text.rlike(r"[(\[{]at[)\]}]|\x20dot\x20"), "ip": text.contains(":"), "card": text.rlike(r"[0-9]{4}[\x20.-][0-9]{4}"), "phone": text.rlike(r"[0-9][)\x20./-][\x20-]?[0-9]{2}"),
        "secret": text.rlike(r"[:=]\x20?\"?[^\s\",;]{6}|[A-Za-z0-9+/_=-]{24}"),
    }

    def strict(k: str) -> Column:
        """Matches of the base pattern; numbers that fail their check are no base spans, an address that fails is nothing."""
        long = lambda x: F.length(_digits(x["m"])) >= 9 if k in ("card", "phone") else valid(k, x["m"])
        return F.transform(F.filter(F.when(could[k], _matches(text, BASE[k])).otherwise(none), long), lambda x: _votes(k, x, valid(k, x["m"])))

    def loose(k: str) -> Column:
        return F.transform(F.when(may[k], _matches(text, WIDE[k])).otherwise(none), lambda x: _votes(k, x, F.lit(False)))

    touches = lambda x, b: F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    free = lambda b, w: F.concat(b, F.filter(w, lambda x: ~touches(x, b)))
    split = lambda all_: let(F.filter(all_, lambda x: x["base"]), lambda b: F.when(F.size(b) == F.size(all_), b).otherwise(free(b, F.filter(all_, lambda x: ~x["base"]))))
    return let(F.concat(*[strict(k) for k in BASE_KINDS], *[loose(k) for k in KINDS]), split)


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then the longer; of those beyond the base ones that overlap, the first stays."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int")
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank(x).alias("k"), (-x["e"]).alias("no"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))))
    kind = "struct<s:int,k:int,no:int,e:int,kind:string,base:boolean>"

    def step(a: Column, x: Column) -> Column:
        fits = x["base"] | (x["s"] >= a["upto"])
        return F.struct(F.when(x["base"] | ~fits, a["upto"]).otherwise(x["e"]).alias("upto"), F.when(fits, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{kind}>").alias("out"))
    thinned = lambda p: F.when(F.forall(p, lambda x: x["base"]), p).otherwise(F.aggregate(p, start, step, lambda a: a["out"]))
    return F.transform(let(placed, thinned), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base")))


def em(cells: list[dict], rounds: int = 100) -> tuple[dict, dict]:
    """Posterior of each vote pattern (kind, *votes), and the labelers' reliabilities, from counted cells."""
    pats: dict[tuple, float] = {}
    for c in cells:
        key = (c["kind"], *(c[x] for x in LABELERS))
        pats[key] = pats.get(key, 0) + c["n"]
    post = {p: min(0.95, max(0.05, 0.4 + 0.15 * sum(p[1:]))) for p in pats}
    rel: dict = {}
    for _ in range(rounds):
        prior, rel = {}, {}
        for k in {p[0] for p in pats}:
            mine = [p for p in pats if p[0] == k]
            yes, all_ = sum(pats[p] * post[p] for p in mine), sum(pats[p] for p in mine)
            prior[k] = (yes + 1) / (all_ + 2)
            for j, name in enumerate(LABELERS, 1):
                for v in (-1, 0, 1):
                    hit = [p for p in mine if p[j] == v]
                    # a labeler that votes is taken to be right more often than not to begin with
                    rel[k, name, v, 1] = (sum(pats[p] * post[p] for p in hit) + 2 + v) / (yes + 6)
                    rel[k, name, v, 0] = (sum(pats[p] * (1 - post[p]) for p in hit) + 2 - v) / (all_ - yes + 6)
        new = {}
        for p in pats:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(math.log(rel[p[0], name, v, 1] / rel[p[0], name, v, 0]) for name, v in zip(LABELERS, p[1:]))
            new[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        moved = max((abs(new[p] - post[p]) for p in pats), default=0)
        post = new
        if moved < 1e-6:
            break
    return post, rel


def _features(c: dict) -> list[str]:
    k = c["kind"]
    return [k, *(f"{k}:{x}={c[x]}" for x in LABELERS), f"{k}:size={c['size']}", f"{k}:spaced={c['spaced']}"]


def fit(cells: list[dict], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> dict[str, float]:
    """Weights of the logistic span classifier, fitted to the posteriors over counted cells (damped counts)."""
    post, _ = em(cells)
    w: dict[str, float] = {}
    data = [(_features(c), post[(c["kind"], *(c[x] for x in LABELERS))], math.log1p(c["n"])) for c in sorted(cells, key=str)]
    total = sum(n for *_, n in data) or 1
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for names, y, n in data:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w.get(x, 0) for x in names)))))
            for x in names:
                grad[x] = grad.get(x, 0) + n * (y - p) / total
        for x, g in grad.items():
            w[x] = w.get(x, 0) + 10 * rate * (g - ridge * w.get(x, 0))
    return w


CELL = ("kind", *LABELERS, "size", "spaced")


def train(docs: DataFrame) -> dict[str, float]:
    """The classifier, from the candidates of all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, ("text", "string")).select(F.explode(candidates(text)).alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in CELL]).agg(F.count("*").alias("n"))
    return fit([r.asDict() for r in rows.collect()])  # 7,290 cells at most


def accepted(spans: Column, weights: dict[str, float], threshold: float = THRESHOLD) -> Column:
    """The base spans and those that the classifier accepts."""

    def score(x: Column) -> Column:
        out = F.lit(0.0)
        for name, w in sorted(weights.items()):
            kind, _, rest = name.partition(":")
            if not rest:
                out = out + F.when(x["kind"] == kind, w).otherwise(0.0)
                continue
            f, _, v = rest.partition("=")
            out = out + F.when((x["kind"] == kind) & (x[f].cast("string") == v.lower()), w).otherwise(0.0)
        return out

    if not weights:
        return F.filter(spans, lambda x: x["base"])
    return F.filter(spans, lambda x: x["base"] | (score(x) >= math.log(threshold / (1 - threshold))))


def find(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id and spans: array of (s, k, e, kind, base) by start, then kind."""
    weights = train(docs) if weights is None else weights
    rows = only(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", candidates(F.coalesce(F.col("text"), F.lit(""))).alias("c"))
    return rows.select("doc_id", _ordered(accepted(F.col("c"), weights)).alias("spans"))


def mask(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; overlapping spans become one mark."""
    weights = train(docs) if weights is None else weights
    text = F.col("text")

    def cover(spans: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            new = x["s"] >= a["pos"]
            add = F.concat(F.substring(text, a["pos"] + 1, x["s"] - a["pos"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
            return F.struct(F.greatest(a["pos"], x["e"]).alias("pos"), F.when(new, F.concat(a["out"], add)).otherwise(a["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
        return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))

    (name,) = fresh(docs.columns, "spans")
    rows = docs.withColumn(name, _ordered(accepted(candidates(F.coalesce(text, F.lit(""))), weights)))
    return rows.withColumn("text", F.when(F.size(name) > 0, cover(F.col(name))).otherwise(text)).drop(name)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    rows = find(table(spark, sf_dir, "documents"))
    base = rows.withColumn("base", F.filter("spans", lambda x: x["base"]))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    count = [of(k).alias(f"n_{k}") for k in BASE_KINDS]
    return base.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
