"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.functions.text import blocks, let, part, places, running_max

from .common import table

#: The base kinds in their order, with patterns in possessive form. A possessive
#: repeat matches the same text where nothing that it could give back is wanted after it; it
#: keeps long runs linear and off the matcher's stack. A match starts where its run starts or
#: where the match before it has ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds. Each needs its check and a score of at least MIN_SCORE.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{16,}+",
    "number": r"(?<![0-9A-Za-z+.-])[0-9]{2,4}[\x20-][0-9]{2,4}[\x20-][0-9]{3,4}(?![0-9A-Za-z-])",
}
#: score of a confirmed span, and words nearby that raise it, in English, German, French and Spanish
_CALL = "phone|call|tel|fax|mobile|mobil|handy|rufen|anruf|portable|appel|llam|móvil|whatsapp|number|nummer|numéro|número"
SCORES = {
    "email": (0.9, "mail|contact|write|kontakt|schreib|courriel|écri|correo|escrib"),
    "ip": (0.8, "address|host|server|adresse|serveur|dirección|servidor"),
    "card": (0.95, "card|visa|master|credit|karte|kredit|carte|tarjeta"),
    "phone": (0.85, _CALL),
    "iban": (0.95, "iban|bank|account|konto|compte|cuenta|banque|banco"),
    "secret": (0.8, "key|token|secret|password|schlüssel|passwort|mot de passe|clé|clave|contraseña"),
    "number": (0.4, _CALL + "|ssn|social security|sozialversicherung|sécurité sociale|seguridad social"),
}
MIN_SCORE, RAISE, CONTEXT = 0.5, 0.3, 40
KINDS = [*BASE, *ADDED]


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d):
    """Digits from the right: every second counts double, less 9 above 9; the sum is a multiple of 10."""
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a
        + F.when(
            F.pmod(n - i, F.lit(2)) == 1,
            F.pmod(F.substr(d, i, F.lit(1)).cast("int") * 2 - 1, F.lit(9)) + F.when(F.substr(d, i, F.lit(1)) == "0", F.lit(-8)).otherwise(F.lit(1)),
        ).otherwise(F.substr(d, i, F.lit(1)).cast("int")),
    )
    return F.pmod(total, F.lit(10)) == 0


def _mod97(x):
    """The first four characters go to the end, letters count 10 to 35; the number modulo 97 is 1."""
    plain = F.regexp_replace(x, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a)
        .when(c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97)))
        .otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))),
    )
    return rest == 1


def _confirmed(kind: str, x):
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & _mod97(x)
    return F.lit(True)


def _may_occur(kind: str, text):
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "secret":
        return text.contains("=") | text.contains(":")
    return text.rlike("[0-9]")


def _matches(kind: str, text, pattern: str):
    """Gaps between a kind's leftmost, non-overlapping matches, and the matches themselves; laid end to
    end they give the places."""
    return F.when(
        _may_occur(kind, text),
        F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")),
    )


#: Matches of a kind, of four characters at least, that can lie within CONTEXT characters, and one more.
_NEAR = CONTEXT // 4 + 1


def _spans(kind: str, m):
    """array<struct<kind, start, end, x, before, after>>; before and after are the CONTEXT characters of the
    whole text, lower-cased, on each side of a match. Places come from running sums of the lengths, contexts
    from the few matches and gaps that are near."""
    reach = F.lit(CONTEXT)
    first, last = (lambda x: F.left(x, reach)), (lambda x: F.right(x, reach))

    def of(gaps, found):
        ahead = F.transform(found, lambda _, i: F.concat(first(F.get(gaps, i + 1)), first(F.coalesce(F.get(found, i + 1), F.lit("")))))
        behind = F.transform(found, lambda _, i: F.concat(last(F.coalesce(F.get(found, i - 1), F.lit(""))), last(F.get(gaps, i))))
        near = F.struct(places(gaps, found).alias("at"), ahead.alias("ahead"), behind.alias("behind"))

        def span(near, x, i):
            since = F.greatest(i - _NEAR + 2, F.lit(1))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), F.get(near["at"], i).alias("start"), (F.get(near["at"], i) + F.length(x)).alias("end"), x.alias("x"),
                F.lower(last(F.array_join(F.slice(near["behind"], since, i - since + 2), ""))).alias("before"),
                F.lower(first(F.array_join(F.slice(near["ahead"], i + 1, F.lit(_NEAR)), ""))).alias("after"),
            )

        return let(near, lambda near: F.transform(found, lambda x, i: span(near, x, i)))

    empty = F.array().cast("array<struct<kind:int,start:int,end:int,x:string,before:string,after:string>>")
    spans = let(m, lambda m: F.when(F.size(m["found"]) > 0, of(m["gaps"], m["found"])))
    return F.coalesce(spans, empty)


def _apart(base, added):
    """The spans of ``added`` that no span of ``base`` overlaps: both are sorted into one order, in which the furthest
    end of the base spans so far tells."""
    kinds = "array<struct<pos:int,side:int,end:int,own:struct<start:int,kind:int,end:int,score:double>>>"
    marks = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("pos"), F.lit(1).alias("side"), b["end"].alias("end"), F.lit(None).alias("own"))).cast(kinds),
            F.transform(added, lambda a: F.struct(a["end"].alias("pos"), F.lit(0).alias("side"), F.lit(0).alias("end"), a.alias("own"))).cast(kinds),
        )
    )

    def of(marks):
        ends = running_max(F.transform(marks, lambda k: k["end"]))
        free = F.filter(F.zip_with(marks, ends, lambda k, end: F.struct(k["own"].alias("own"), end.alias("end"))), lambda k: k["own"].isNotNull() & (k["end"] <= k["own"]["start"]))
        return F.transform(free, lambda k: k["own"])

    return F.when(F.size(added) > 0, let(marks, of)).otherwise(added)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, pii, base): the columns of ``docs`` as one struct, whatever their names; all spans (array of start,
    kind, end, score; by start, then kind); and those of the base kinds, in the same form.

    Places count code points, end exclusive. Base kinds are the leftmost non-overlapping matches
    that pass their check (parts at most 255, Luhn, digit counts); a match that fails is dropped
    and not tried again. Added kinds are account numbers (mod 97), named secrets and grouped
    numbers; context words within CONTEXT characters before or after a match raise its score, and added
    spans need MIN_SCORE and must not overlap a base span. Null or empty text has no span.
    """
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    out = docs.select(F.struct(*docs.columns).alias("row"))
    out = out.select("row", *[_matches(k, text, p).alias(f"m_{k}") for k, p in (BASE | ADDED).items()])
    out = out.select("row", *[_spans(k, F.col(f"m_{k}")).alias(f"s_{k}") for k in KINDS])

    def scored(kind: str):
        score, words = SCORES[kind]
        good = F.filter(F.col(f"s_{kind}"), lambda s: _confirmed(kind, s["x"]))
        return F.transform(
            good,
            lambda s: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                F.least(F.lit(1.0), F.lit(score) + F.when(s["before"].rlike(words) | s["after"].rlike(words), F.lit(RAISE)).otherwise(F.lit(0.0))).alias("score"),
            ),
        )

    added = F.filter(F.concat(*[scored(k) for k in ADDED]), lambda s: s["score"] >= MIN_SCORE)
    out = out.select("row", F.array_sort(F.concat(*[scored(k) for k in BASE])).alias("base"), added.alias("added"))
    free = let(F.struct("base", "added"), lambda x: _apart(x["base"], x["added"]))
    return out.select("row", F.array_sort(F.concat("base", free)).alias("pii"), "base")


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; a span that starts within
    the one before it is replaced together with that. Columns stay as they are; null text stays null.
    """
    found = find_pii(docs, text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("row")[text_col]

    def replaced(x):
        spans, cut = x["pii"], x["blocks"]
        # how far the spans before each reach
        reached = F.transform(spans, lambda s: s["end"])

        def joined(reached):
            def piece(s, i):
                at = F.when(i > 0, F.get(reached, i - 1)).otherwise(F.lit(0))
                return F.when(s["start"] >= at, F.concat(part(cut, at, s["start"] - at), F.element_at(names, s["kind"] + 1))).otherwise(F.lit(""))

            end = F.element_at(reached, -1)
            return F.concat(F.array_join(F.transform(spans, piece), ""), part(cut, end, x["size"] - end))

        return let(running_max(reached), joined)

    parts = let(F.struct(F.col("pii"), blocks(text).alias("blocks"), F.length(text).alias("size")), replaced)
    clean = F.when(F.size("pii") > 0, parts).otherwise(text).alias(text_col)
    return found.select(*[clean if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores).

    scores: that of each span, in the order of ``spans``. Null or empty text: counts 0, the digest of
    the empty string, no spans. Null ids, ties and repeated rows: each row stays by itself. Extra
    columns are ignored. Empty input gives no rows. Only column functions are used.
    """
    found = find_pii(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def count(i: int):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        F.col("row")["doc_id"].alias(id_col), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"),
        scores.alias("scores"),
    )


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))
