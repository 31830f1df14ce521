"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from strict patterns (the base kinds) and looser ones. Labelers vote on each
candidate: a shape check, a gazetteer, the words before it, the characters around it, and words that speak against it. Besides the base kinds there are
names with a title, secrets (keys and tokens) and numbers of persons and accounts. The votes of
all documents are counted by pattern (kinds x 3**labelers rows at most), expectation-maximisation on
these counts estimates every labeler's reliability, and each pattern gets a posterior. The final span
classifier is naive Bayes over bounded span features, with counts weighted by those posteriors. It
decides the added spans; spans of the base patterns always stay.

Positions come from marking matches: a pattern's matches are wrapped in two control characters, and the
pieces between marks are measured. Those characters are first replaced in the text, one for one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table

#: The strict patterns. Possessive loops match what the greedy ones match here and need no stack; a
#: look-behind only skips starts inside a run from whose head the same match would have been tried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser shapes for added spans.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{2,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,63} ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]{1,24}(?: [A-Z][a-z]{1,24})?",
    "secret": r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,200}+={0,2}(?![A-Za-z0-9+/_=.-])",
    "id": r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])",
}
#: What a text must hold for a loose pattern to be tried.
QUICK = {
    "email": r"[\[(]at[\])]",
    "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "name": r"\b(?:M[rs]|Mrs|Dr|Herr|Frau|Mme|Sra?)\.? ",
    "secret": r"[A-Za-z0-9+/_-]{20}",
    "id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
}
HINTS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}
KINDS = ("email", "ip", "card", "phone", "name", "secret", "id")
#: Words that speak for a kind when they stand before a span.
CONTEXT = {
    "email": "mail|email|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|mastercard|karte|carte|tarjeta|credit",
    "phone": "tel|phone|call|fax|mobile|telefon|téléphone|teléfono|ruf",
    "name": "by|from|dear|von|de|por|signed|contact",
    "secret": "token|secret|key|apikey|api_key|access_key|password|passwd|pwd|auth|authorization|bearer|credential|credentials|private",
    "id": "ssn|social|iban|account|passport|konto|compte|cuenta|tax",
}
#: Gazetteer: top-level domains, private networks, card prefixes, area and country prefixes, honorifics.
GAZETTEER = {
    "email": r"(?i)\.(?:com|net|org|edu|gov|info|de|fr|es|uk|io)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|44|49)|\(?[2-9])",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)",
    # forms of well-known keys: cloud and code-host prefixes, web tokens, hexadecimal digests of 32, 40 or 64 digits
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk[-_]|AIza|eyJ)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
    "id": r"^(?:(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)|(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2})",
}
OPEN, CLOSE = "\u0001", "\u0002"
WINDOW = 32
_CHUNK = 64
SPAN = "struct<kind:string,start:int,end:int,m:string,before:string,after:string,base:boolean>"


def _spans(text, pattern: str):
    """All matches as array<struct<start,end,m>>, in code points."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    kind = "array<struct<start:int,end:int,m:string>>"

    def step(a, p):
        end = (a["at"] + F.length(p)).cast("int")
        hit = F.array(F.struct(a["at"].cast("int").alias("start"), end.alias("end"), p.alias("m")))
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["out"], hit)).otherwise(a["out"]).alias("out"))

    def measured(ps):
        """Matches by chunks of ``_CHUNK`` pieces, an even number, so each begins outside a match: an array grows by copying, so long ones are put together of short ones."""
        chunks = F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / _CHUNK).cast("int"))
        part = lambda c: F.slice(ps, c * _CHUNK + 1, F.lit(_CHUNK))
        lengths = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), lambda a, p: a + F.length(p)))

        def at(sums):
            before = lambda c: F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda a, n: a + n)
            state = lambda c: F.struct(before(c).alias("at"), F.lit(False).alias("hit"), F.expr(f"cast(array() as {kind})").alias("out"))
            return F.flatten(F.transform(chunks, lambda c: F.aggregate(part(c), state(c), step, lambda a: a["out"])))

        return _bound(lengths, at)

    return _bound(pieces, measured)


def _bound(value, use):
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m):
    digits = F.split(F.reverse(_digits(m)), "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m):
    if kind == "ip":
        # a part is at most 255 if, without its zeros, it is short and small
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(short(p)) <= 3, short(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 13) & (n <= 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _none():
    return F.expr(f"cast(array() as array<{SPAN}>)")


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, spans: base spans by kind as listed and place, then loose ones that touch no base span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.translate(text, OPEN + CLOSE, "\u0003\u0003").alias("text"))

    def full(kind, base):
        t = F.col("text")

        def build(x):
            return F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"),
                F.substring(t, F.greatest(x["start"] - WINDOW, F.lit(0)) + 1, F.least(x["start"], F.lit(WINDOW))).alias("before"),
                F.substring(t, x["end"] + 1, F.lit(2)).alias("after"), F.lit(base).alias("base"),
            )

        return build

    def base(kind):
        hint = F.col("text").rlike("[0-9]") if kind != "email" else F.lit(True)
        for h in HINTS[kind]:
            hint = hint & F.contains("text", F.lit(h))
        found = F.filter(_spans(F.col("text"), BASE[kind]), lambda x: _valid(kind, x["m"]))
        return F.when(hint, F.transform(found, full(kind, True))).otherwise(_none())

    def loose(kind):
        found = F.transform(_spans(F.col("text"), LOOSE[kind]), full(kind, False))
        if kind == "secret":  # plain words are no secrets
            found = F.filter(found, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
        return F.when(F.col("text").rlike(QUICK[kind]), found).otherwise(_none())

    rows = rows.withColumn("base", F.concat(*[base(k) for k in BASE])).withColumn("loose", F.concat(*[loose(k) for k in LOOSE]))
    free = F.filter("loose", lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return rows.select("doc_id", F.concat("base", free).alias("spans"))


def _by_kind(table_: dict[str, str], x, test):
    out = F.lit(False)
    for kind, value in table_.items():
        out = F.when(x["kind"] == kind, test(value)).otherwise(out)
    return out


def votes(x):
    """One character a labeler: 1 for, 0 against, - abstains."""
    digits = F.length(_digits(x["m"]))
    word = F.lower(F.regexp_extract(x["before"], r"([\p{L}-]+)[^\p{L}]*$", 1))
    near = _by_kind(CONTEXT, x, lambda w: F.lower(x["before"]).rlike(rf"(?<!\p{{L}})(?:{w})(?!\p{{L}})"))
    gaz = _by_kind(GAZETTEER, x, lambda p: x["m"].rlike(p))
    mixed = (digits >= 6) & (digits < F.length(x["m"])) & ~x["m"].rlike(r"[-_/].*[-_/].*[-_/]")
    shape = F.when(x["base"], "1").when(x["kind"] == "phone", F.when(digits == 10, "1").otherwise("0")).when(x["kind"] == "secret", F.when(mixed, "1").otherwise("0")).otherwise("-")
    clear = ~x["before"].rlike(r"[\p{L}0-9_=#/]$") & ~x["after"].rlike(r"^[\p{L}0-9_=/]")
    return F.concat(
        shape,
        F.when(gaz, "1").otherwise("0"),
        F.when(near, "1").otherwise("-"),
        F.when(clear, "1").otherwise("0"),
        F.when(word.isin("version", "chapter", "section", "build", "isbn", "sha", "commit", "hash", "digest", "checksum", "md5", "sha1", "sha256") | ((x["kind"] != "secret") & word.isin("token", "key", "id")), "0").otherwise("-"),
    )


def features(x):
    """Bounded categories of a span."""
    kind = lambda c: F.when(c.rlike(r"\p{L}"), "a").when(c.rlike("[0-9]"), "9").when(c.rlike(r"\s"), "_").when(c == "", "^").otherwise(".")
    return F.array(
        F.concat(F.lit("b"), kind(F.substring(x["before"], -1, 1))),
        F.concat(F.lit("a"), kind(F.substring(x["after"], 1, 1))),
        F.concat(F.lit("n"), F.least(F.length(_digits(x["m"])), F.lit(20)).cast("string")),
        F.concat(F.lit("l"), F.least(F.length(x["m"]) / 4, F.lit(12)).cast("int").cast("string")),
    )


LABELERS = 5


def expectation_maximisation(counts: dict[tuple[str, str], int], rounds: int = 30) -> tuple[dict, dict]:
    """Posterior of each (kind, vote pattern) and each kind's reliabilities. Starts from the share of
    votes for; one latent class a span; labelers independent given the class; counts smoothed by one."""
    post = {}
    for key in counts:
        said = [v for v in key[1] if v != "-"]
        post[key] = (said.count("1") + 0.5) / (len(said) + 1)
    theta: dict = {}
    for _ in range(rounds):
        for kind in {k for k, _ in counts}:
            mine = {v: n for (k, v), n in counts.items() if k == kind}
            for c in (0, 1):
                weight = {v: n * (post[kind, v] if c else 1 - post[kind, v]) for v, n in mine.items()}
                theta[kind, c] = (sum(weight.values()) + 1, [{s: 1 + sum(w for v, w in weight.items() if v[j] == s) + (4 if (s == "1") == bool(c) and s != "-" else 0) for s in "10-"} for j in range(LABELERS)])
        for kind, v in counts:
            logs = []
            for c in (0, 1):
                total, by = theta[kind, c]
                logs.append(math.log(total) + sum(math.log(by[j][v[j]] / sum(by[j].values())) for j in range(LABELERS)))
            post[kind, v] = 1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1]))))
    return post, theta


def _lookup(pairs: dict[str, float], key):
    if not pairs:
        return F.lit(0.0)
    found = F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])
    return F.coalesce(F.try_element_at(found, key), F.lit(0.0))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end, m, base).

    Base spans always stay; a loose candidate is added if the span classifier gives it ``least`` or more
    and two labelers vote for it. A null text has no spans; null or repeated ids are rows like any other;
    an empty table gives no rows. Positions are code points, ends exclusive.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.table(candidates(docs, id_col, text_col), "candidates")
    each = found.select(F.explode("spans").alias("x")).select(F.col("x.kind").alias("kind"), votes(F.col("x")).alias("votes"), features(F.col("x")).alias("features"))
    patterns = {(r[0], r[1]): r[2] for r in each.groupBy("kind", "votes").count().collect()}  # at most kinds x 3**labelers rows
    post, _ = expectation_maximisation(patterns)
    weight = _lookup({f"{k}:{v}": p for (k, v), p in post.items()}, F.concat_ws(":", "kind", "votes"))
    counts = each.withColumn("p", weight).select("kind", F.explode("features").alias("f"), "p").groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # bounded: kinds x categories
    total = {}
    for r in counts:
        y, n = total.get((r["kind"], r["f"][0]), (0, 0))
        total[r["kind"], r["f"][0]] = (y + r["yes"], n + r["no"])
    score = {}
    for r in counts:
        y, n = total[r["kind"], r["f"][0]]
        score[f"{r['kind']}:{r['f']}"] = math.log((r["yes"] + 1) / (y + 8)) - math.log((r["no"] + 1) / (n + 8))
    prior = {f"{k}:{v}": math.log(max(p, 1e-9) / max(1 - p, 1e-9)) for (k, v), p in post.items()}

    def keep(x):
        logit = _lookup(prior, F.concat_ws(":", x["kind"], votes(x)))
        logit = logit + F.aggregate(features(x), F.lit(0.0), lambda a, f: a + _lookup(score, F.concat_ws(":", x["kind"], f)))
        for_ = F.length(F.translate(votes(x), "0-", ""))
        return x["base"] | ((logit >= math.log(least / (1 - least))) & (for_ >= 2))

    slim = F.transform(F.filter("spans", keep), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), x["base"].alias("base")))
    return found.select("doc_id", slim.alias("spans"))


def op8_pii(spark, sf_dir):
    rows = find_pii(table(spark, sf_dir, "documents"))
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["base"])
    ordered = F.concat(*[F.array_sort(F.filter("spans", lambda x: x["kind"] == k), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"])) for k in KINDS])
    return rows.select(
        "doc_id",
        *[F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(ordered, name), ",").alias("spans"),
    )
