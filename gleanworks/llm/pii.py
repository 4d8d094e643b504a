"""Personal-data spans by weak supervision, in DataFrame expressions only.

Labelers vote on candidate spans; expectation-maximisation over the (bounded)
table of vote patterns estimates each labeler's reliability without gold labels,
and its posteriors train a naive-Bayes span classifier over surface features.

* regex labelers: four base patterns (email, ip, card, phone) with their validity
  checks (octet range, Luhn, digit counts), and patterns for secret tokens, bank
  accounts (IBAN check digits), national ids, names after a title and street addresses;
* gazetteer labelers: reserved or well known mail domains, card issuer prefixes,
  national dialling prefixes, unusable address ranges, IBAN countries, first names,
  usual street names and names of secrets;
* context labelers: cue words shortly before the span, and clean (non-word) borders on
  both sides.

Valid base spans are always kept.  All other candidates are only reported if the
classifier accepts them and their check or a cue supports them: base matches that fail
their check under the kind ``number``, the others under their own.  So base counts never
change.  The label model needs no gold labels and is fitted on the table that it labels;
a model of another table can be given.

Defined results: null text counts as empty and yields no spans; a null doc_id is
kept as it is; duplicate rows are each reported; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns' languages.  Runs are taken possessively and may
# only start at a run's beginning or where the previous match ended, which finds
# the same matches as the plain patterns in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[A-Za-z_]{3,20}\x20?[=:]\x20?[\x22'][A-Za-z0-9+/_-]{16,128}[\x22']",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra)\.?\x20\p{Lu}[\p{L}'-]{1,30}(?:\x20\p{Lu}[\p{L}'-]{1,30})?",
    "address": r"(?<![0-9])[0-9]{1,5}\x20(?:\p{Lu}[\p{L}'-]{1,30}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd)\b|(?<![\p{L}])\p{Lu}\p{L}{1,30}(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]{1,4}\b|(?<![\p{L}])(?:rue|avenue|boulevard|calle|avenida|plaza)\x20[\p{L}'\x20-]{3,40}\x20[0-9]{1,4}\b",
}
BASE = ("email", "ip", "card", "phone")
#: Order of all kinds that are reported.
KINDS = (*BASE, "number", "secret", "iban", "national", "name", "address")
#: What a text must hold for a pattern to be run on it: any of some strings, a plain pattern, or a digit besides.
_MAY_HOLD = {
    "email": ("@",),
    "phone": ("+",),
    "name": ("Mr ", "Mr.", "Mrs", "Ms ", "Ms.", "Dr ", "Dr.", "Prof", "Herr ", "Frau ", "Monsieur", "Madame", "Mme", "Señor", "Sra"),
    "address": (" Street", " St", " Avenue", " Ave", " Road", " Rd", " Lane", " Ln", " Boulevard", " Blvd", "straße ", "strasse ", "weg ", "platz ", "gasse ", "allee ", "rue ", "avenue ", "boulevard ", "calle ", "avenida ", "plaza "),
}
_MAY_MATCH = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "secret": r"[=:]\x20?[\x22']", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "national": r"[0-9]-[0-9]{2}-[0-9]"}
_WITH_DIGIT = ("phone", "ip", "card", "iban", "national", "address")

# Gazetteers and cue words of the labelers.
MAIL_DOMAINS = ("example.com", "example.org", "example.net", "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "proton.me", "protonmail.com", "gmx.de", "gmx.net", "web.de", "t-online.de", "orange.fr", "free.fr", "wanadoo.fr", "laposte.net", "telefonica.net", "terra.es", "aol.com", "mail.com")
CARD_PREFIXES = ("2", "30", "34", "35", "36", "37", "38", "4", "5", "6")
DIAL_PREFIXES = ("+1", "+20", "+27", "+30", "+31", "+32", "+33", "+34", "+36", "+39", "+40", "+41", "+43", "+44", "+45", "+46", "+47", "+48", "+49", "+51", "+52", "+54", "+55", "+56", "+57", "+58", "+60", "+61", "+62", "+63", "+64", "+65", "+66", "+7", "+81", "+82", "+84", "+86", "+90", "+91", "+92", "+351", "+352", "+353", "+358", "+420")
IBAN_COUNTRIES = ("AD", "AE", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IL", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SA", "SE", "SI", "SK", "SM", "TR")
FIRST_NAMES = (
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Peter", "Paul", "Anna", "Emma", "Laura",
    "Hans", "Klaus", "Jürgen", "Wolfgang", "Ursula", "Monika", "Petra", "Sabine", "Stefan", "Andreas", "Heike", "Claudia", "Martin", "Jean", "Pierre", "Michel", "Marie", "Jacques", "Nathalie", "Isabelle", "Sylvie", "Philippe", "Nicolas", "Camille",
    "Antonio", "José", "Manuel", "Francisco", "Juan", "Carmen", "María", "Josefa", "Isabel", "Dolores", "Javier", "Carlos", "Miguel", "Lucía", "Pablo",
)
STREETS = ("Main", "High", "Church", "Park", "Oak", "Elm", "Maple", "Station", "Mill", "School", "Victoria", "King", "Queen", "Washington", "Haupt", "Bahnhof", "Garten", "Schul", "Dorf", "Berg", "Kirch", "Linden", "Goethe", "Schiller", "République", "Gare", "Paix", "Victor", "Église", "Mayor", "Real", "Gran", "Sol", "España", "Constitución")
SECRETS = ("token", "key", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "auth_token", "client_secret", "bearer", "credential", "private_key")
CUES = (
    r"(?i)(mail|e-mail|correo|courriel|contact|kontakt|phone|tel|telefon|teléfono|téléphone|mobile|handy|fax|call|card|karte|tarjeta|carte|visa|mastercard|iban|account|konto|cuenta|compte|bank|ip|host|server|address|adresse|dirección|wohnhaft|"
    r"token|key|secret|password|passwort|contraseña|ssn|social security|ausweis|dni|name|nombre|nom|signed|patient|customer|kunde|cliente|client)[^A-Za-z]{0,4}$"
)

#: Labelers in vote order; every vote is 0 or 1.
LABELERS = ("valid", "gazetteer", "cue", "borders", "shape")
EM_ROUNDS = 25


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn check of a digit string; the weights follow from the distance to the last digit."""
    codes = F.transform(F.split(digits, "(?!^)(?!$)"), lambda d: d.cast("int"))

    def weigh(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when((F.size(codes) - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(codes, weigh), F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(value: Column) -> Column:
    """The remainder that an IBAN's check digits make 1."""
    plain = F.regexp_replace(value, "\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    codes = F.transform(F.split(moved, "(?!^)(?!$)"), lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, "\x20", "")).between(15, 34) & (_mod97(m) == 1)
    if kind == "national":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "name":
        return m.rlike(r"\x20\p{Lu}\S+\x20\p{Lu}")
    return F.lit(True)


def _listed(words: tuple[str, ...]) -> str:
    return "(" + "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in words) + ")"


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lower(m).rlike(f"[@.]{_listed(MAIL_DOMAINS)}$")
    if kind == "card":
        return m.rlike(f"^{_listed(CARD_PREFIXES)}")
    if kind == "phone":
        return m.rlike(f"^{_listed(DIAL_PREFIXES)}([^0-9]|[0-9]{{4,}}$)")
    if kind == "ip":
        return ~m.rlike(r"^(0+|255)\.")
    if kind == "iban":
        return F.substring(m, 1, 2).isin(*IBAN_COUNTRIES)
    if kind == "national":
        return ~m.rlike("^[789]")
    if kind == "name":
        return m.rlike(rf"\x20{_listed(FIRST_NAMES)}(\x20|$)")
    if kind == "address":
        return m.rlike(_listed(STREETS))
    return m.rlike(rf"(?i)^{_listed(SECRETS)}\x20?[=:]")


def _shape(kind: str, m: Column) -> Column:
    """A labeler of the span's own surface: plausible lengths and grouping."""
    if kind == "email":
        return F.length(m).between(6, 64)
    if kind == "ip":
        return F.length(m).between(7, 15)
    if kind == "card":
        return F.length(_digits(m)).isin(15, 16)
    if kind == "phone":
        return m.rlike(r"^\+[0-9]{1,3}[\x20(.-]")
    if kind == "iban":
        return F.length(F.regexp_replace(m, "\x20", "")).between(15, 31)
    if kind == "name":
        return F.length(m).between(6, 50)
    if kind in ("address", "national"):
        return F.length(m).between(8, 60)
    return m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]")


_SPANS = "cast(array() as array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>)"


def _walk(kind: str) -> Column:
    """Spans of one pattern from its matches and the gaps between them; offsets in code points."""
    found, gaps = F.col(f"found_{kind}"), F.col(f"gaps_{kind}")

    def step(acc: Column, i: Column) -> Column:
        gap, value = F.element_at(gaps, i), F.element_at(found, i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(24)).alias("before"), F.left(F.element_at(gaps, i + 1), F.lit(1)).alias("after"))
        keep = F.length(_digits(value)).between(12, 19) if kind == "card" else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    empty = F.expr(_SPANS)
    walked = F.aggregate(F.sequence(F.lit(1), F.size(found)), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: every pattern's matches in each row's whole text, valid or not.

    Card matches with digit counts that no card or account number has are left out.
    Matches and gaps are columns of their own, so each pattern runs once a text.
    """
    text = F.col("text")
    one = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn("_digit", text.rlike("[0-9]"))

    def may(kind: str) -> Column:
        if kind in _MAY_HOLD:
            held = F.lit(False)
            for mark in _MAY_HOLD[kind]:
                held = held | text.contains(mark)
        else:
            held = text.rlike(_MAY_MATCH[kind])
        return F.col("_digit") & held if kind in _WITH_DIGIT else held

    one = one.select("doc_id", "text", *[may(k).alias(f"may_{k}") for k in PATTERNS])
    two = one.select(
        "doc_id",
        *[F.when(F.col(f"may_{k}"), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"found_{k}") for k, p in PATTERNS.items()],
        *[F.when(F.col(f"may_{k}"), F.split(text, p, -1)).alias(f"gaps_{k}") for k, p in PATTERNS.items()],
    )
    return two.select("doc_id", F.concat(*[_walk(k) for k in PATTERNS]).alias("spans"))


def _votes(s: Column) -> dict[str, Column]:
    """The labelers' votes on one span struct."""
    kind, value = s["kind"], s["value"]

    def by_kind(f) -> Column:
        out = F.lit(False)
        for k in PATTERNS:
            out = F.when(kind == k, f(k, value)).otherwise(out)
        return out

    return {
        "valid": by_kind(_valid),
        "gazetteer": by_kind(_gazetteer),
        "cue": s["before"].rlike(CUES) | (kind == "secret"),
        "borders": ~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]"),
        "shape": by_kind(_shape),
    }


def _features(s: Column) -> Column:
    """What the classifier sees besides votes: length class and kinds of border."""
    length = F.length(s["value"])
    return F.concat_ws("|", F.when(length < 10, "s").when(length < 20, "m").otherwise("l"), F.when(s["before"].rlike(r"\s$|^$"), "w").when(s["before"].rlike("[.,;:(]$"), "p").otherwise("x"), F.when(s["after"].rlike(r"^\s|^$"), "w").when(s["after"].rlike("^[.,;:)]"), "p").otherwise("x"))


def estimate(patterns: list[tuple], rounds: int = EM_ROUNDS) -> dict[str, dict]:
    """Dawid-Skene EM over vote patterns ``(kind, votes..., count)``; per kind a prior, reliabilities and posteriors.

    The table has at most ``kinds * 2 ** labelers`` rows, whatever the corpus.
    """
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1:-1], p[-1]) for p in patterns if p[0] == kind]
        k, prior = len(rows[0][0]), 0.5
        sens, spec = [0.8] * k, [0.8] * k
        post: dict = {}
        for _ in range(rounds):
            for votes, _n in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(votes):
                    a += math.log(sens[j] if v else 1 - sens[j])
                    b += math.log(1 - spec[j] if v else spec[j])
                post[votes] = 1 / (1 + math.exp(min(700, max(-700, b - a))))
            yes = sum(post[v] * n for v, n in rows)
            no = sum((1 - post[v]) * n for v, n in rows)
            # Beta(4, 1) pseudo-counts keep a labeler better than chance, so the classes cannot swap.
            sens = [min(0.999, max(0.5, (4 + sum(post[v] * n * v[j] for v, n in rows)) / (5 + yes))) for j in range(k)]
            spec = [min(0.999, max(0.5, (4 + sum((1 - post[v]) * n * (1 - v[j]) for v, n in rows)) / (5 + no))) for j in range(k)]
            prior = min(0.98, max(0.02, (yes + 1) / (yes + no + 2)))
        out[kind] = {"prior": prior, "sensitivity": sens, "specificity": spec, "posterior": dict(post)}
    return out


def train(candidate_rows: DataFrame) -> dict[str, tuple[float, dict[str, float]]]:
    """Label model then span classifier: per kind an intercept and log-odds by vote and by feature."""
    span = F.col("span")
    votes = [v.cast("int").alias(k) for k, v in _votes(span).items()]
    # A plain explode would infer a filter on the array and push it, patterns and all, into the lambdas: quadratic in a text's matches.
    counted = candidate_rows.select(F.explode_outer("spans").alias("span")).where("span IS NOT NULL").select(span["kind"].alias("kind"), *votes, _features(span).alias("features")).groupBy("kind", *LABELERS, "features").count().collect()
    total: dict[tuple, int] = {}
    for r in counted:
        key = (r["kind"], *[r[v] for v in LABELERS])
        total[key] = total.get(key, 0) + r["count"]
    label_model = estimate([(*k, n) for k, n in sorted(total.items())])
    model = {}
    for kind, est in label_model.items():
        weights: dict[str, list[float]] = {}
        pos = neg = 1.0
        for r in (r for r in counted if r["kind"] == kind):
            p = est["posterior"][tuple(r[v] for v in LABELERS)]
            pos, neg = pos + p * r["count"], neg + (1 - p) * r["count"]
            for f in [f"{v}{r[v]}" for v in LABELERS] + [r["features"]]:
                w = weights.setdefault(f, [0.0, 0.0])
                w[0] += p * r["count"]
                w[1] += (1 - p) * r["count"]
        model[kind] = (math.log(pos / neg), {f: round(math.log((a + 1) / (pos + 1)) - math.log((b + 1) / (neg + 1)), 6) for f, (a, b) in sorted(weights.items())})
    return model


def find_pii(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``(doc_id, base, extra)``: valid base spans, and the spans that the trained classifier adds.

    Both are ``array<struct<kind, start, end, value>>`` ordered by start, then kind
    as in ``KINDS``.  Spans of a row are scored inside the row (no shuffle); the only
    exchange is the bounded table of vote patterns that trains the model.
    """
    rows = candidates(docs)
    if model is None:
        model = train(rows)
    votes = rows.withColumn("spans", F.transform("spans", lambda s: _judged(s, model)))
    order = F.array(*[F.lit(k) for k in KINDS])

    def ordered(keep, rename) -> Column:
        kept = F.transform(F.filter("spans", keep), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, rename(s)).alias("rank"), s["end"].alias("end"), rename(s).alias("kind"), s["value"].alias("value")))
        return F.transform(F.array_sort(kept), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    base = ordered(lambda s: s["valid"] & s["kind"].isin(*BASE), lambda s: s["kind"])
    extra = ordered(lambda s: s["accepted"] & ~(s["valid"] & s["kind"].isin(*BASE)), lambda s: F.when(s["kind"].isin(*BASE), F.lit("number")).otherwise(s["kind"]))
    return votes.select("doc_id", base.alias("base"), extra.alias("extra"))


def _judged(s: Column, model: dict) -> Column:
    """One span struct with its validity and the classifier's verdict."""
    kind, votes = s["kind"], _votes(s)
    logit = F.lit(-1.0)
    for k, (intercept, weights) in model.items():
        total = F.lit(intercept)
        for v, vote in votes.items():
            total = total + F.when(vote, F.lit(weights.get(f"{v}1", 0.0))).otherwise(F.lit(weights.get(f"{v}0", 0.0)))
        shapes = {f: w for f, w in weights.items() if "|" in f}
        if shapes:
            total = total + F.coalesce(F.create_map(*[x for f, w in shapes.items() for x in (F.lit(f), F.lit(w))])[_features(s)], F.lit(0.0))
        logit = F.when(kind == k, total).otherwise(logit)
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), votes["valid"].alias("valid"), ((logit > 0) & (votes["valid"] | votes["cue"])).alias("accepted"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_weak_pii(docs: DataFrame) -> DataFrame:
    """The contract's digest columns from ``find_pii``'s spans, and ``n_extra`` and ``n_spans``, the added ones and all.

    A null text is empty and has no spans, a null doc_id is kept, repeated rows are each
    reported, other columns are ignored, an empty table gives an empty result.
    """
    found = find_pii(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    more = [F.size("extra").cast("long").alias("n_extra"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans")]
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(every)).alias("spans"), *more)
