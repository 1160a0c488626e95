"""Personal data by rules and weak supervision, with DataFrame functions only.

Base kinds are found by fixed patterns and checks, leftmost and non-overlapping. The
method adds spans of further kinds: postal addresses, dates of birth, national and bank
ids, names of persons, and secrets. Each has a loose pattern of candidates, on which
regex, gazetteer and context labelers vote; of a secret the value alone is the candidate,
and the key before it votes. For each kind, expectation-maximisation over the counts of
vote patterns (a bounded table, whatever the corpus) estimates how reliable each labeler
is; the posterior of each pattern then trains a logistic span classifier on votes and
shape. Candidates it gives at least one half are added, unless they overlap a base span
or one of a kind listed before.

Positions are code points, ends exclusive. They come from the pieces between matches,
so one pass over a text gives all its spans.

Defined cases: a null text is empty; texts of any length are read whole; repeated rows
and null ids get their own results; a corpus without candidates adds nothing; a score of
exactly one half adds; an empty table stays empty; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. A match can start where a run of its first class starts, or where the
# match before it ended; elsewhere in the run it would fail as well, so starts inside a
# run are not tried and long runs stay linear. Repeated groups are possessive: nothing
# follows them, and Java then loops where it would recurse.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds that the method adds, in the order in which they take precedence.
ADDED = ("address", "birth", "id", "name", "secret")
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_GIVEN = "(?:James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Susan|Richard|Jessica|Thomas|Sarah|Hans|Ursula|Peter|Anna|Karl|Marie|Pierre|Jean|Claire|Luc|Carlos|Carmen|Jose|Lucia|Ahmed|Fatima|Wei|Priya)"
_TITLE = "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sra?)"
_CAPITAL = "[A-Z\u00c0-\u00de][a-z\u00df-\u00ff]+"
# Loose patterns of the candidates, and what a text must hold to have one.
CANDIDATES = {
    "address": (
        r"(?<![0-9A-Za-z])(?:[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Place|Way)(?![A-Za-z])"
        r"|[A-Z][a-z\u00df-\u00ff]{2,20}(?:stra\u00dfe|strasse|weg|platz|gasse) [0-9]{1,4}(?![0-9])"
        r"|[0-9]{1,4},? (?:rue|avenue|boulevard) (?:de |du |des |la |le ){0,2}[A-Z\u00c0-\u00de][a-z\u00df-\u00ff]+)",
        "[0-9] [A-Za-z]|(?:stra\u00dfe|strasse|weg|platz|gasse) [0-9]|[0-9], [rab]",
    ),
    "birth": (
        rf"(?<![0-9])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./](?:19|20)[0-9]{{2}}|[0-9]{{1,2}} {_MONTH} (?:19|20)[0-9]{{2}}|{_MONTH} [0-9]{{1,2}}, (?:19|20)[0-9]{{2}})(?![0-9])",
        "[0-9]{4}-[0-9]{2}-[0-9]|[./](?:19|20)[0-9]{2}|[a-z0-9],? (?:19|20)[0-9]{2}",
    ),
    "id": (
        r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[A-CEGHJ-PR-TW-Z]{2}(?: ?[0-9]{2}){3} ?[A-D])(?![0-9A-Za-z-])",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2} ?[0-9]{2}",
    ),
    "name": (rf"(?<![A-Za-z])(?:{_TITLE}\.? {_CAPITAL}(?: {_CAPITAL}){{0,2}}|{_GIVEN} {_CAPITAL})", f"{_TITLE}\\.? [A-Z\u00c0-\u00de]|{_GIVEN} [A-Z\u00c0-\u00de]"),
    # opaque runs with a letter and a digit; an assignment sign is not part of them
    "secret": (
        r"(?<![A-Za-z0-9_+/-])(?:eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){1,2}|(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+={0,2})",
        "[A-Za-z0-9_+/-]{12}",
    ),
}

SPAN = "array<struct<start:int,end:int>>"
CANDIDATE = "array<struct<start:int,end:int,votes:string,shape:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = _digits(match)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(match: Column) -> Column:
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3))).cast("int") <= 255)
    return F.forall(F.split(match, r"\."), small)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(lengths: Column) -> Column:
    """The sum of all entries before each one of an array.

    An aggregation that grows an array copies it at every step, so sums are made in
    chunks of about the root of the length, and the chunks are summed likewise.
    """
    grown = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    add = lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["before"], F.array(done["at"])).alias("before"))

    def chunked(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(1), F.size(x), step), lambda i: F.aggregate(F.slice(x, i, step), grown, add))
        starts = lambda c: F.aggregate(c, grown, lambda done, own: add(done, own["at"]))["before"]
        return _let(chunks, lambda c: F.flatten(F.zip_with(c, starts(c), lambda own, at: F.transform(own["before"], lambda n: n + at))))

    return _let(lengths, lambda x: F.when(F.size(x) > 0, chunked(x)).otherwise(F.array().cast("array<int>")))


def walk(text: Column, pattern: str, keep: Callable[[Column, Column, Column, Column], Column], kind: str) -> Column:
    """What ``keep`` makes of each match that it does not give null for.

    ``keep`` gets the match, its start, and the texts before and after it (up to the
    neighbouring matches).
    """
    pieces = F.split(text, pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("match"), p.alias("piece"), F.lit("").alias("after")))
    zipped = F.filter(zipped, lambda x: x["match"].isNotNull())

    def made(items: Column) -> Column:
        before = sums_before(F.transform(items, lambda x: F.length(x["piece"]) + F.length(x["match"])))
        return F.zip_with(items, before, lambda x, at: keep(x["match"], at + F.length(x["piece"]), x["piece"], x["after"]))

    return F.filter(_let(zipped, made), lambda x: x.isNotNull()).cast(kind)


def _spans(text: Column, pattern: str, valid: Callable[[Column], Column] | None) -> Column:
    def keep(match: Column, start: Column, _before: Column, _after: Column) -> Column:
        span = F.struct(start.alias("start"), (start + F.length(match)).alias("end"))
        return span if valid is None else F.when(valid(match), span)

    return walk(text, pattern, keep, SPAN)


# What announces each kind (fixed values), looked for in the 40 characters before a candidate, in lower case.
GAZETTEER = {
    "address": r"\b(?:address|lives? (?:at|on|in)|residence|resident|ship to|located at|wohnt|wohnhaft|adresse|domicile|domicilio)\b",
    "birth": r"\b(?:born|dob|birth|birthday|birthdate|geboren|geburtsdatum|naissance|nacido|nacida|nacimiento)\b",
    "id": r"\b(?:ssn|social security|iban|national insurance|nino|passport|tax id|steuernummer|account)\b",
    "name": r"\b(?:name is|named|signed|sincerely|regards|contact|dear|called|hei\u00dft|appelle|llamo)\b",
    "secret": r"(?:^|[^a-z])(?:[a-z_-]*[_-])?(?:password|passwd|passwort|pwd|passphrase|secret|token|api[_-]?key|apikey|key|auth|authorization|bearer|credentials?|session|sid)[^a-z0-9]*$",
}
CONTEXT = {
    "address": r"(?: at| in| on|:|,)\s*$", "birth": r"(?:born|dob|birth|birthday|birthdate|geboren|geburtsdatum|naissance|nacid[oa]|nacimiento)(?: on| is| was| am| le| el)?[\s:=]*$",
    "id": r"(?:number|no\.?|nr\.?|ssn|iban|is|id)?[\s]*[:#=]?\s*$", "name": r"(?: is|:|,|by|from|dear)\s*$", "secret": r"(?:[=:]\s*[\"'`]?|bearer\s+|[\"'`])$",
}
#: Strict forms of each kind.
STRICT = {
    "address": r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|stra\u00dfe|strasse|rue|avenue|boulevard)",
    "birth": r"^(?:(?:19[0-9]{2}|20[01][0-9])-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|.*(?:19[0-9]{2}|20[01][0-9]))$",
    "id": r"^(?:(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}[A-Z0-9 ]{11,}|[A-Z]{2}(?: ?[0-9]{2}){3} ?[A-D])$",
    "name": rf"{_CAPITAL} {_CAPITAL}$",
    "secret": r"^(?:A[KS]IA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{18,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|[0-9a-f]{32,}|[0-9A-F]{32,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_.-]{16,})$",
}


def votes(kind: str, match: Column, before: Column) -> Column:
    """One character per labeler: 1 for the kind, 0 against, - for no opinion."""
    tail = F.lower(F.right(before, F.lit(40)))
    vote = lambda yes, other: F.when(yes, "1").otherwise(other)
    said = [vote(match.rlike(STRICT[kind]), "0" if kind in ("birth", "id") else "-")]
    # what is sure by its form may stand without an announcement
    silent = {"address": "-", "birth": "0", "id": "-", "name": "-", "secret": "0"}[kind]
    said += [vote(tail.rlike(GAZETTEER[kind]), silent), vote(tail.rlike(CONTEXT[kind]), silent)]
    if kind == "secret":
        share = F.length(_digits(match)) / F.length(match)
        said += [vote(share.between(0.05, 0.9) & (F.length(match) >= 16), "0"), F.when(match.rlike(r"[a-z]{9,}|[-/_]{2,}|[a-z]-[a-z]+-[a-z]"), "0").otherwise("-")]
    if kind == "name":
        said += [vote(match.rlike(rf"^{_TITLE}\b"), "-"), vote(match.rlike(rf"\b{_GIVEN}\b"), "-")]
    return F.concat(*said)


def shape(match: Column) -> Column:
    """Length and mix of characters, in three grades each."""
    n, share = F.length(match), F.length(_digits(match)) / F.length(match)
    grade = lambda c, a, b: F.when(c < a, "a").when(c < b, "b").otherwise("c")
    return F.concat(grade(n, 20, 32), grade(share, 0.25, 0.5))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and the candidates of each added kind with votes and shape."""
    text = F.col("body")
    none = F.array().cast(SPAN)
    checks = {
        "email": (EMAIL, text.contains("@"), None), "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), _octets),
        "card": (CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), _luhn), "phone": (PHONE, text.rlike(r"\+[0-9]"), _phone),
    }
    spans = [F.when(guard, _spans(text, p, valid)).otherwise(none).alias(k) for k, (p, guard, valid) in checks.items()]

    def candidates(kind: str) -> Column:
        def candidate(match: Column, start: Column, before: Column, _after: Column) -> Column:
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), votes(kind, match, before).alias("votes"), shape(match).alias("shape"))

        pattern, guard = CANDIDATES[kind]
        return F.when(text.rlike(guard), walk(text, pattern, candidate, CANDIDATE)).otherwise(F.array().cast(CANDIDATE)).alias(f"maybe_{kind}")

    picked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    return picked.select("doc_id", *spans, *map(candidates, ADDED))


def estimate(patterns: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], float]:
    """Posterior of each vote pattern and the share of secrets, by EM (one coin a labeler and class)."""
    names = list(patterns)
    n = np.array([patterns[p] for p in names], float)
    said = {v: np.array([[c == v for c in p] for p in names], float) for v in "10-"}
    # to start, believe the majority
    post = np.clip((said["1"].sum(1) + 0.5) / (said["1"].sum(1) + said["0"].sum(1) + 1), 0.05, 0.95)
    share = 0.5
    for _ in range(rounds):
        log = np.zeros((2, len(names)))
        share = float((n @ post + 1) / (n.sum() + 2))
        for y, weight in ((1, n * post), (0, n * (1 - post))):
            rate = {v: (weight @ said[v] + 0.5) / (weight.sum() + 1.5) for v in said}
            log[y] = sum(said[v] @ np.log(rate[v]) for v in said) + np.log(share if y else 1 - share)
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(names, post.tolist(), strict=True)), share


def _features(votes_: str, shape_: str) -> list[str]:
    return [f"v{i}{c}" for i, c in enumerate(votes_)] + [f"s{i}{c}" for i, c in enumerate(shape_)]


def train(counts: dict[tuple[str, str], int], steps: int = 400, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of the span classifier from the counts of (votes, shape)."""
    by_votes: dict[str, float] = {}
    for (v, _), n in counts.items():
        by_votes[v] = by_votes.get(v, 0.0) + n
    post, _ = estimate(by_votes)
    names = sorted({f for v, s in counts for f in _features(v, s)})
    x = np.array([[f in _features(v, s) for f in names] for v, s in counts], float)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([post[v] for v, _ in counts])
    n = np.array(list(counts.values()), float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (p - y)) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip([*names, "bias"], w.tolist(), strict=True))


def score(candidate: Column, weights: dict[str, float]) -> Column:
    """Linear score of a candidate: at least zero means at least one half."""
    total = F.lit(weights.get("bias", 0.0))
    for name, w in weights.items():
        if name != "bias":
            field = candidate["votes"] if name[0] == "v" else candidate["shape"]
            total = total + F.when(F.substr(field, F.lit(int(name[1]) + 1), F.lit(1)) == name[2], w).otherwise(0.0)
    return total


def annotate(docs: DataFrame) -> DataFrame:
    """doc_id, and an array of (start, end) for each base kind and each of ``ADDED``."""
    rows = materialise(found(docs), "pii-spans")

    def patterns(kind: str) -> Column:
        return F.transform(f"maybe_{kind}", lambda c: F.struct(F.lit(kind).alias("kind"), c["votes"].alias("votes"), c["shape"].alias("shape")))

    def accepted(kind: str, weights: dict[str, float], taken: Column) -> Column:
        free = lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.filter(f"maybe_{kind}", lambda c: (score(c, weights) >= 0) & free(c))

    one = F.explode(F.concat(*map(patterns, ADDED)))
    seen = rows.select(one.alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    counts: dict[str, dict[tuple[str, str], int]] = {}
    for r in seen.collect():  # at most 3^5 vote patterns by 9 shapes of each kind
        counts.setdefault(r["kind"], {})[r["votes"], r["shape"]] = r["count"]
    out, taken = rows, F.concat(*KINDS)
    for kind in ADDED:
        good = F.array().cast(SPAN)
        if kind in counts:
            good = accepted(kind, train(counts[kind]), taken)
        out = out.withColumn(kind, F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
        taken = F.concat(taken, F.col(kind))
    return out.select("doc_id", *KINDS, *ADDED)


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")
