"""Personal data by weak supervision, in DataFrame operations only.

Candidates are regex matches of whole texts with code-point positions. Four base kinds
follow fixed rules and always stay; further kinds (local phone numbers, masked
addresses, names, social security numbers, bank accounts) are candidates that the
method accepts or not. Labelers vote yes, no or abstain on every candidate, base or not:

* regex: the shape of the match holds up to a stricter pattern of its kind,
* gazetteer: its parts are in lists (given names, mail hosts, card issuers, reserved networks),
* context for: words just before it announce it,
* context against: words around it explain it otherwise (versions, licences, prices, figures),
* edges: it is not part of a longer word or number.

Votes and kind are the only things learnt from, so the corpus enters as counts of vote
patterns: one grouped aggregate over all candidates, at most ``kinds * 3 ** 5`` rows. On
these counts expectation-maximisation estimates how reliable each labeler is and the
probability of each pattern, and a logistic span classifier is trained on those
probabilities; it is applied as a column expression.

An empty table gives no rows and a model without evidence. Of a caller's columns ``detect`` replaces ``spans``,
``_found`` and the working columns ``_m0`` ... and ``_g0`` ...; ``redact`` leaves all columns but the text alone.
Null and empty texts have no spans. A text's spans stay in its row (no shuffle of
texts, no group to gather); rows may repeat. Quantifiers are possessive where
nothing can be given back, and a match may only begin where a longer one cannot, so
long runs of one kind of character cost linear time and no deep recursion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
#: kind -> (what a text must hold to be searched, pattern). The first four are the base kinds, in their order.
KINDS = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[0-9][\x20-]?){14}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "phone_local": (r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
                    r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"),
    "email_masked": (r"[\[(]at[\])]",
                     rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]++)++"),
    "name": (r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]|[Mm]y name is |[Nn]ame: ",
             r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof)\.? |[Mm]y name is |[Nn]ame: )[A-Z][a-z]++(?: [A-Z][a-z]++){0,2}"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}\x20?[A-Z0-9]{4}",
             r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
BASE = list(KINDS)[:4]
LABELERS = ["regex", "gazetteer", "context_for", "context_against", "edges"]
SPAN = "struct<kind: string, start: int, end: int, text: string, before: string, after: string>"

# Word lists of the labelers; our own choice.
GIVEN_NAMES = """Anna Maria Emma Laura Julia Sarah Lisa Sofia Marie Claire Elena Carmen Lucia Isabel Eva Nina Clara Alice
Emily Olivia Jane Mary Susan Karen Linda Barbara Elizabeth Jennifer Patricia Michael Thomas Peter Paul John James Robert
David Daniel Martin Andreas Stefan Hans Klaus Karl Pierre Jean Jacques Louis Luis Carlos Jose Juan Pedro Miguel Antonio
Marco Luca George William Henry Charles Edward Richard Joseph Mark Steven Kevin Brian Alexander Max Felix Lukas""".split()
MAIL_HOSTS = r"@(?:mail|smtp|mx|gmail|googlemail|outlook|hotmail|yahoo|icloud|proton|gmx|web|aol|live|msn)[0-9]*\."
RESERVED_NETWORKS = r"^(?:0|127|255)\.|^(?:0\.0\.0\.0|255\.255\.255\.255)$|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"
ANNOUNCING = {
    "email": r"(?i)e-?mail|contact|write|correo|courriel|schreib|reach|address",
    "ip": r"(?i)\bip\b|address|host|server|from|login|client|adresse",
    "card": r"(?i)card|visa|master|amex|credit|debit|carte|karte|tarjeta|pay",
    "phone": r"(?i)phone|\btel|call|fax|mobile|cell|whatsapp|telefon|t[eé]l[eé]",
    "phone_local": r"(?i)phone|\btel|call|fax|mobile|cell|whatsapp|telefon|t[eé]l[eé]",
    "email_masked": r"(?i)e-?mail|contact|write|correo|courriel|schreib|reach|address",
    "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\.? $|[Mm]y name is $",
    "ssn": r"(?i)\bssn\b|social security",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
}
OTHERWISE = r"(?i)version|\bv\.?$|license|licence|figure|\bfig\.?|section|isbn|issn|page|chapter|price|\$$|€$|order|invoice|doi|build"


def contains(text: Column, what: str) -> Column:
    """A cheap test for texts worth searching: plain substring for one sign, else a regular expression."""
    return F.contains(text, F.lit(what)) if len(what) == 1 else text.rlike(what)


def _valid(kind: str, text: Column) -> Column:
    """Whether a match passes its kind's check; failing matches are dropped."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        turned = F.split(F.reverse(digits), "(?<=.)(?=.)")
        total = F.aggregate(F.transform(turned, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5))), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_found``: array of spans (kind, start, end, text, what stands before and after)."""
    text = F.col(text_col)
    cols = {}
    for k, (kind, (needs, pattern)) in enumerate(KINDS.items()):
        worth = contains(text, needs)
        cols[f"_m{k}"] = F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        cols[f"_g{k}"] = F.when(worth, F.split(text, pattern, -1))
    out = docs.withColumns(cols)
    found = [F.when(F.size(f"_m{k}") > 0, _spans(kind, F.col(f"_m{k}"), F.col(f"_g{k}"))).otherwise(F.array().cast(f"array<{SPAN}>"))
             for k, kind in enumerate(KINDS)]
    return out.withColumn("_found", F.concat(*found)).drop(*cols)


def _spans(kind: str, m: Column, g: Column) -> Column:
    """Spans of the matches ``m`` of a text cut into the gaps ``g`` around them, without those that fail the check."""
    n = F.size(m)
    steps = F.zip_with(F.zip_with(m, F.slice(g, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("gap"))),
                       F.slice(g, 2, n), lambda s, y: F.struct(s["x"].alias("x"), s["gap"].alias("gap"), y.alias("rest")))

    def add(acc, s):
        start = acc["pos"] + F.length(s["gap"])
        end = start + F.length(s["x"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), s["x"].alias("text"),
                        F.right(s["gap"], F.lit(48)).alias("before"), F.left(s["rest"], F.lit(24)).alias("after"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.filter(F.aggregate(steps, zero, add, lambda acc: acc["out"]), lambda s: _valid(kind, s["text"]))


def votes(s: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1, -1 or 0 (abstains)."""
    kind, text, before, after = s["kind"], s["text"], s["before"], s["after"]
    digits = F.regexp_replace(text, "[^0-9]", "")
    pick = lambda cases, other=0: reduce(
        lambda acc, kv: acc.when(kind == kv[0], kv[1]), list(cases.items())[1:], F.when(kind == next(iter(cases)), next(iter(cases.values())))
    ).otherwise(F.lit(other))
    yes = lambda c, no=-1: F.when(c, 1).otherwise(F.lit(no))
    mail = r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}$"
    names = "^(?:" + "|".join(GIVEN_NAMES) + r")\b"
    return {
        "regex": pick({
            "email": yes(text.rlike(mail)), "ip": yes(text.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$")),
            "card": yes(text.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$")),
            "phone": yes(text.rlike(r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}$")),
            "phone_local": yes(text.rlike(r"^\([2-9][0-9]{2}\) |^[2-9][0-9]{2}[.-]")),
            "email_masked": yes(text.rlike(r"[A-Za-z]{2,}$")), "name": yes(text.rlike(" "), 0),
            "ssn": yes(~text.rlike("^(?:000|666|9)|-00-|-0000$")), "iban": yes(F.length(F.regexp_replace(text, " ", "")).between(15, 34))}),
        "gazetteer": pick({
            "email": yes(F.lower(text).rlike(MAIL_HOSTS), 0), "ip": F.when(text.rlike(RESERVED_NETWORKS), -1).otherwise(F.lit(0)),
            "card": yes(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6)")), "phone": yes(digits.rlike("^(?:1|2[07]|3[0-469]|4|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")),
            "name": yes(text.rlike(names))}),
        "context_for": pick({k: yes(before.rlike(p), 0) for k, p in ANNOUNCING.items()}),
        "context_against": F.when(F.right(before, F.lit(16)).rlike(OTHERWISE) | after.rlike("^ ?(?:%|USD|EUR|kg|km)"), -1).otherwise(F.lit(0)),
        "edges": F.when(before.rlike("[A-Za-z0-9_/=]$") | after.rlike("^[A-Za-z0-9_/=]"), -1).otherwise(F.lit(1)),
    }


@dataclass
class Model:
    """Labelers' reliabilities and the span classifier."""

    share: float = 0.5
    reliability: dict = field(default_factory=dict)  # labeler -> {(vote, is personal): probability}
    bias: float = 0.0
    weights: dict = field(default_factory=dict)      # (labeler, vote) or kind -> weight


def logistic(rows: list, post: list[float], steps: int) -> tuple[dict, float]:
    """(weights, bias) of the logistic regression of ``post`` on votes and kinds, patterns weighted by their share of all spans.

    Newton's method on a convex loss: the end depends on the shares, not on how many spans there are.
    """
    keys = [(x, y) for x in LABELERS for y in (1, -1)] + list(KINDS)
    if not rows:
        return dict.fromkeys(keys, 0.0), 0.0
    on = [{(x, y) for x, y in zip(LABELERS, vote, strict=True)} | {kind} for kind, vote, _ in rows]
    x = np.array([[float(k in o) for k in keys] + [1.0] for o in on])
    share, p = np.array([n for _, _, n in rows], float), np.array(post)
    share /= share.sum()
    ridge = np.array([1e-3] * len(keys) + [1e-9])

    def loss(w):
        z = x @ w
        return share @ (np.logaddexp(0, z) - p * z) + ridge @ (w * w) / 2

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (z - p)) + ridge * w
        move = np.linalg.solve((x.T * (share * z * (1 - z))) @ x + np.diag(ridge), grad)
        gain, size = grad @ move, 1.0
        if gain < 1e-16:
            break
        while size > 1e-9 and loss(w - size * move) > loss(w) - size * gain / 4:
            size /= 2
        w -= size * move
    return dict(zip(keys, map(float, w[:-1]), strict=True)), float(w[-1])


def fit(candidates: DataFrame, rounds: int = 25, steps: int = 400) -> Model:
    """EM over the counts of vote patterns, then logistic regression on its posteriors; both on the bounded table of patterns."""
    spans = candidates.select(F.explode("_found").alias("s"))
    v = votes(F.col("s"))
    rows = spans.select(F.col("s.kind").alias("kind"), *[c.alias(k) for k, c in v.items()]).groupBy("kind", *LABELERS).agg(
        F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["kind"], tuple(int(r[x]) for x in LABELERS), r["n"]) for r in rows)
    prior = {(1, True): 0.6, (0, True): 0.3, (-1, True): 0.1, (1, False): 0.2, (0, False): 0.3, (-1, False): 0.5}
    m = Model(0.7, {x: dict(prior) for x in LABELERS})
    total = sum(n for _, _, n in rows)
    post: list[float] = []
    for _ in range(rounds if rows else 0):
        post = []
        for _, vote, _ in rows:
            a, b = math.log(m.share), math.log(1 - m.share)
            for x, y in zip(LABELERS, vote, strict=True):
                a, b = a + math.log(m.reliability[x][y, True]), b + math.log(m.reliability[x][y, False])
            post.append(1 / (1 + math.exp(min(b - a, 700))))
        personal = sum(p * n for p, (_, _, n) in zip(post, rows, strict=True))
        m.share = min(max((personal + 1) / (total + 2), 0.01), 0.99)
        for k, x in enumerate(LABELERS):  # the prior counts as 20 spans of either class
            for y in (1, 0, -1):
                yes = sum(p * n for p, (_, vote, n) in zip(post, rows, strict=True) if vote[k] == y)
                no = sum((1 - p) * n for p, (_, vote, n) in zip(post, rows, strict=True) if vote[k] == y)
                m.reliability[x][y, True] = (yes + 20 * prior[y, True]) / (personal + 20)
                m.reliability[x][y, False] = (no + 20 * prior[y, False]) / (total - personal + 20)
    weights, bias = logistic(rows, post, steps)
    m.weights, m.bias = weights, bias
    return m


def probability(s: Column, m: Model) -> Column:
    """The span classifier as a column expression."""
    z = F.lit(m.bias)
    for x, c in votes(s).items():
        z = z + F.when(c == 1, m.weights.get((x, 1), 0.0)).when(c == -1, m.weights.get((x, -1), 0.0)).otherwise(0.0)
    for kind in KINDS:
        z = z + F.when(s["kind"] == kind, m.weights.get(kind, 0.0)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def with_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, rank, end, kind, base>>, sorted by start, then kind as listed.

    All base spans, and further ones that the classifier accepts and no base span overlaps.
    """
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    base = F.filter("_found", lambda s: s["kind"].isin(BASE))
    more = F.filter("_found", lambda s: ~s["kind"].isin(BASE))
    more = F.filter(more, lambda s: (probability(s, model) >= 0.5) & ~F.exists(
        F.filter("_found", lambda b: b["kind"].isin(BASE)), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    slim = lambda a: F.transform(a, lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["kind"].isin(BASE).alias("base")))
    spans = F.when(F.size("_found") > 0, F.array_sort(F.concat(slim(base), slim(more))))
    empty = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string, base: boolean>>")
    return with_candidates(docs, text_col).withColumn("spans", F.coalesce(spans, empty)).drop("_found")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Model]:
    """(``docs`` with ``spans``, in place of any such column; the fitted model). One pass counts vote patterns, a second one applies the classifier."""
    model = fit(with_candidates(docs.select(text_col), text_col))
    return with_spans(docs, model, text_col), model


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of a text replaced by ``<KIND>``; where spans overlap the earlier one counts."""
    # the row travels as one struct, so that no column of its can clash with those made here
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("text"))
    found, _ = detect(held, "text")
    text, spans = F.col("text"), F.col("spans")

    def step(acc, s):
        clear = s["start"] >= acc["pos"]
        cut = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(clear, s["end"]).otherwise(acc["pos"]).alias("pos"),
                        F.when(clear, cut).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    new = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    new = F.when(F.size(spans) > 0, new).otherwise(text)
    return found.select(*[new.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
