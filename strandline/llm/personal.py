"""Personal data: base patterns, and weak supervision for spans beyond them.

Base kinds (email, ip, card, phone) are found by regular expressions and checks.
Further candidates (keys and passwords, social security numbers, local phone
numbers) are voted on by labelers: strict shape, a gazetteer of cue words before
the span, context before the span, and the mix of its characters. Expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is (Dawid-Skene), and a logistic classifier of votes and kind, trained on
the posteriors, decides each span. The gazetteer is a table of words by kind; a word
of the span's own kind votes for it, one of another kind against it.

All of it is DataFrame expressions. What reaches the driver is the table of vote
patterns with counts, at most KINDS * 3**LABELERS rows; the fitted model goes
back as literals. Regular expressions are written so that none backtracks over a
long text: every loop is possessive, and a match starts only where a run does.

Defined results: a null or empty text has no spans; null ids stay as they are;
repeated rows give repeated rows; an empty table gives an empty result. Offsets count
code points, ends are exclusive. A text with n matches costs n to the power of 1.5 at
most, in small steps: no array or text is copied once a match. One text's spans are
held together with the text.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from . import _shared

BASE = ("email", "ip", "card", "phone")
ADDED = ("key", "local", "ssn")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
CANDIDATE = r"(?<![A-Za-z0-9_+.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_-])|(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{14,}+)"
#: words that announce a kind; any: keys and passwords as well as numbers
GAZETTEER = {
    "key": ("password", "passwd", "pass", "pwd", "passwort", "kennwort", "contraseña", "clave", "mot", "passe", "token", "secret", "geheim", "apikey", "api", "key", "schlüssel", "auth", "authorization", "bearer", "credential", "credentials", "access", "private", "signature", "session", "cookie", "login"),
    "ssn": ("ssn", "social", "security", "sozialversicherungsnummer", "sécurité", "sociale", "seguro", "seguridad", "taxpayer", "tin", "itin"),
    "local": ("tel", "telephone", "phone", "mobile", "cell", "cellphone", "call", "fax", "kontakt", "contact", "telefon", "handy", "mobil", "anruf", "téléphone", "teléfono", "móvil", "llame", "appelez", "whatsapp", "sms", "hotline", "number", "nummer", "numéro", "número"),
}
ASSIGN = r"[=:\"'][\x20\"']{0,2}$"
BEFORE = 24
LABELERS = 4
_FOUND = "array<struct<start:int,end:int,hit:string,lead:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row even inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _slices(n: Column) -> Column:
    """Starts, from 1, of stretches of about the square root of n elements each, and their length: structs of at and size."""
    size = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    return _let(size, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), k), lambda i: F.struct(i.alias("at"), k.alias("size"))))


def _located(text: Column, regex: str) -> Column:
    """All matches with their code-point offsets, and the BEFORE code points before each.

    Offsets are sums over stretches of matches first, then within a stretch, so no
    array is copied once a match: the work is n to the power of 1.5 at most, of n matches.
    """
    none = F.array().cast(_FOUND)

    def whole(m: Column) -> Column:
        gaps, hits = m["gaps"], m["hits"]
        far = lambda i: F.length(F.element_at(gaps, i)) + F.length(F.element_at(hits, i))
        sizes = F.transform(F.sequence(F.lit(1), F.size(hits)), far)

        def hit(i: Column, at: Column) -> Column:
            gap, text = F.element_at(gaps, i), F.element_at(hits, i)
            # a candidate is of 11 code points or more with one at least between two, so two matches back suffice
            early = [F.when(i > k, F.concat(F.element_at(gaps, F.greatest(i - k, F.lit(1))), F.element_at(hits, F.greatest(i - k, F.lit(1))))).otherwise("") for k in (2, 1)]
            lead = F.when(F.length(gap) >= BEFORE, F.right(gap, F.lit(BEFORE))).otherwise(F.right(F.concat(*early, gap), F.lit(BEFORE)))
            start = at + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("hit"), lead.alias("lead"))

        def stretch(sizes: Column, at: Column, first: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(sizes, first, k), F.struct(at.alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])
            return F.transform(inner, lambda at, j: hit(first + j, at))

        def bases(sizes: Column, parts: Column) -> Column:
            one = lambda acc, p: F.struct((acc["at"] + F.aggregate(F.slice(sizes, p["at"], p["size"]), F.lit(0), lambda a, x: a + x)).alias("at"), F.array_append(acc["all"], F.struct(acc["at"].alias("base"), p["at"].alias("first"), p["size"].alias("size"))).alias("all"))
            return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,first:int,size:int>>").alias("all")), one, lambda acc: acc["all"])

        found = _let(sizes, lambda z: F.flatten(F.transform(bases(z, _slices(F.size(z))), lambda p: stretch(z, p["base"], p["first"], p["size"]))))
        return F.when(F.size(hits) == 0, none).otherwise(found)

    return _let(F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits")), whole)


def _clear(x: Column, spans: Column) -> Column:
    """Whether no span of an ascending array without overlaps meets x: by binary search for the last that starts before x ends."""
    step = lambda k, p: F.when((k + p <= F.size(spans)) & (F.get(spans, k + p - 1)["start"] < x["end"]), k + p).otherwise(k)
    before = F.aggregate(F.array(*(F.lit(1 << p) for p in range(30, -1, -1))), F.lit(0), step)
    return _let(before, lambda k: (k == 0) | (F.get(spans, k - 1)["end"] <= x["start"]))


def _digits(hit: Column) -> Column:
    return F.translate(hit, " -().+", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, turned.substr(i, F.lit(1)).cast("int")).otherwise((turned.substr(i, F.lit(1)).cast("int") * 2 - F.when(turned.substr(i, F.lit(1)).cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _spans(kind: str, wanted: Column, text: Column, regex: str, good) -> Column:
    found = F.filter(F.when(wanted, _located(text, regex)).otherwise(F.array().cast(_FOUND)), lambda x: good(x["hit"]))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _base(text: Column) -> list[Column]:
    """Spans of each base kind, ascending."""
    digit = text.rlike("[0-9]")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    size = lambda h, a, b: F.length(_digits(h)).between(a, b)
    return [
        _spans("email", text.contains("@"), text, EMAIL, lambda h: h.isNotNull()),
        _spans("ip", digit & text.rlike(r"[0-9]\.[0-9]"), text, IP, lambda h: h.rlike(rf"^(?:{octet}\.){{3}}{octet}$")),
        _spans("card", digit & text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), text, CARD, lambda h: F.when(size(h, 16, 19), _luhn(_digits(h))).otherwise(False)),
        _spans("phone", text.contains("+") & digit, text, PHONE, lambda h: size(h, 8, 15)),
    ]


def _votes(hit: Column, before: Column) -> Column:
    """-1, 0 or 1 of each labeler, and the candidate's kind."""
    ssn = hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    local = hit.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
    kind = F.when(ssn, "ssn").when(local, "local").otherwise("key")
    shape = (
        F.when(ssn, F.when(hit.rlike(r"^(?:000|666|9)|-00-|0000$"), -1).otherwise(1))
        .when(local, F.when(hit.rlike(r"^\(?[01]"), -1).otherwise(1))
        .when(hit.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), 1)
        .when(hit.rlike(r"^[0-9_-]+$|^[A-Za-z_-]+[0-9]{1,4}$"), -1)
        .otherwise(0)
    )
    words = F.slice(F.reverse(F.array_remove(F.split(F.lower(before), r"[^\p{L}]+", -1), "")), 1, 3)
    cues = {k: F.arrays_overlap(words, F.array(*map(F.lit, v))) for k, v in GAZETTEER.items()}
    cue = F.when(reduce(or_, ((kind == k) & c for k, c in cues.items())), 1).when(reduce(or_, ((kind != k) & c for k, c in cues.items())), -1).otherwise(0)
    context = F.when(before.rlike(ASSIGN), 1).when(before.rlike(r"[/?&#.]$"), -1).otherwise(0)
    mixed = F.when(ssn | local, 0).when(F.length(F.regexp_replace(hit, "[^0-9]", "")) * 6 >= F.length(hit), F.when(hit.rlike("[A-Za-z]"), 1).otherwise(-1)).otherwise(-1)
    return F.struct(kind.alias("kind"), *(x.cast("int").alias(f"v{i}") for i, x in enumerate((shape, cue, context, mixed))))


def labelled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, base spans, and candidates with their votes, with all columns of documents first if carry is set."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(*([F.struct(*documents.columns).alias("row")] if carry else []), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns(dict(zip(BASE, _base(F.col("text")))))
    rows = rows.withColumn("seen", F.when(F.col("text").rlike("[0-9]"), _located(F.col("text"), CANDIDATE)).otherwise(F.array().cast(_FOUND)))
    rows = rows.withColumn("seen", F.filter("seen", lambda x: reduce(and_, (_clear(x, F.col(k)) for k in BASE))))
    rows = rows.withColumn("candidates", F.transform("seen", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _votes(x["hit"], x["lead"]).alias("votes"))))
    return rows.withColumn("base", F.concat(*BASE)).drop("text", "seen", *BASE)


def fit(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> dict:
    """Label model and classifier from vote patterns with their counts.

    The classifier's features are a bias, each kind, and two marks a labeler
    (voted for, voted against). Without patterns, votes for and against weigh 1.
    """
    names = [("kind", k) for k in ADDED] + [("vote", i, v) for i in range(LABELERS) for v in (1, -1)]
    weights = {n: float(n[2]) if n[0] == "vote" else 0.0 for n in names} | {"bias": -1.0}
    patterns = sorted(patterns)
    if not patterns:
        return weights
    post = {p[:2]: 1 / (1 + math.exp(1.0 - 1.5 * sum(p[1]))) for p in patterns}
    for _ in range(rounds):
        table, prior = {}, {}
        for kind, votes, n in patterns:
            for z, w in ((1, post[kind, votes] * n), (0, (1 - post[kind, votes]) * n)):
                prior[z] = prior.get(z, 1.0) + w
                for i, v in enumerate(votes):
                    table[z, i, v] = table.get((z, i, v), 0.0) + w
        # a labeler is taken to do better than chance: pseudo-counts of its agreeing votes keep the classes from changing places
        rate = lambda z, i, v: (table.get((z, i, v), 0.0) + (4.0 if v == (1 if z else -1) else 2.0 if v == 0 else 1.0)) / (sum(table.get((z, i, u), 0.0) for u in (-1, 0, 1)) + 7.0)  # noqa: E731, B023
        for kind, votes, _n in patterns:
            log = [math.log(prior[z]) + sum(math.log(rate(z, i, v)) for i, v in enumerate(votes)) for z in (0, 1)]
            post[kind, votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, log[0] - log[1]))))
    total = sum(n for *_, n in patterns)
    for _ in range(400):
        step = dict.fromkeys(weights, 0.0)
        for kind, votes, n in patterns:
            on = ["bias", ("kind", kind), *(("vote", i, v) for i, v in enumerate(votes) if v)]
            gap = (post[kind, votes] - 1 / (1 + math.exp(-sum(weights[f] for f in on)))) * n / total
            for f in on:
                step[f] += gap
        for f in weights:
            weights[f] += 2.0 * (step[f] - 1e-4 * weights[f])
    return weights


def _score(votes: Column, weights: dict) -> Column:
    total = F.lit(weights["bias"])
    for k in ADDED:
        total = total + F.when(votes["kind"] == k, weights["kind", k]).otherwise(0.0)
    for i in range(LABELERS):
        total = total + F.when(votes[f"v{i}"] == 1, weights["vote", i, 1]).when(votes[f"v{i}"] == -1, weights["vote", i, -1]).otherwise(0.0)
    return total


def _decided(rows: DataFrame) -> DataFrame:
    """Adds the column spans: base spans, then added ones by kind and start."""
    votes = F.col("c.votes")
    counts = rows.select(F.explode("candidates").alias("c")).groupBy(votes["kind"].alias("kind"), *(votes[f"v{i}"].alias(f"v{i}") for i in range(LABELERS))).count()
    weights = fit([(r[0], tuple(r[1:-1]), r[-1]) for r in counts.collect()])
    kept = F.filter("candidates", lambda x: _score(x["votes"], weights) >= 0)
    added = F.array_sort(F.transform(kept, lambda x: F.struct(x["votes"]["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return rows.withColumn("spans", F.concat("base", added))


def find_personal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and all spans, each a struct of kind, start and end."""
    return _decided(_shared.written(labelled(documents, id_col, text_col), "personal")).select("doc_id", "base", "spans")


def mask_personal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """documents with every span of its texts replaced by the name of its kind; other columns stay."""
    rows = _decided(_shared.written(labelled(documents, id_col, text_col, carry=True), "personal"))
    text = F.col("row")[text_col]
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    top = lambda spans, p: F.aggregate(F.slice(spans, p["at"], p["size"]), F.lit(0), lambda a, x: F.greatest(a, -x["end"]))
    stretches = lambda spans: F.transform(_slices(F.size(spans)), lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), top(spans, p).alias("top")))
    masked = _let(by_start, lambda spans: _let(stretches(spans), lambda parts: F.array_join(F.transform(parts, lambda p: _masked_stretch(text, spans, parts, p, mask)), "")))
    return rows.select(*(F.when(F.size("spans") > 0, masked).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in documents.columns))


def _masked_stretch(text: Column, spans: Column, parts: Column, p: Column, mask: str) -> Column:
    """The text from a stretch's first span to the next stretch's, with its spans masked; the first stretch begins at 0, the last goes to the text's end.

    spans: in order of start, then of falling end (end is negative). One span that
    meets an earlier one is masked with it. The text is cut once a stretch, and each
    stretch's text once a span.
    """
    mine = F.slice(spans, p["at"], p["size"])
    begin = F.when(p["at"] == 1, 0).otherwise(F.get(spans, p["at"] - 1)["start"])
    begin = F.greatest(begin, F.aggregate(parts, F.lit(0), lambda a, q: F.when(q["at"] < p["at"], F.greatest(a, q["top"])).otherwise(a)))
    last = p["at"] + p["size"] > F.size(spans)
    stop = F.when(last, F.length(text)).otherwise(F.get(spans, p["at"] + p["size"] - 1)["start"])
    name = lambda k: F.replace(F.lit(mask), F.lit("{}"), F.upper(k))

    def build(x: Column) -> Column:
        piece, first = x["piece"], x["begin"]
        step = lambda acc, s: F.struct(F.greatest(acc["at"], -s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["done"]).otherwise(F.array_append(acc["done"], F.concat(piece.substr(acc["at"] - first + 1, s["start"] - acc["at"]), name(s["kind"])))).alias("done"))
        end = lambda acc: F.concat(F.array_join(acc["done"], ""), F.when(acc["at"] - first < F.length(piece), piece.substr(acc["at"] - first + 1, F.length(piece))).otherwise(""))
        return F.aggregate(mine, F.struct(first.alias("at"), F.array().cast("array<string>").alias("done")), step, end)

    return _let(F.struct(begin.alias("begin"), stop.alias("stop")), lambda e: _let(F.struct(e["begin"].alias("begin"), F.when(e["stop"] > e["begin"], text.substr(e["begin"] + 1, e["stop"] - e["begin"])).otherwise("").alias("piece")), build))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, the base spans' digest, and all spans as text."""
    code = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(code("base"), 256).alias("base_sha256"), code("spans").alias("spans"))
