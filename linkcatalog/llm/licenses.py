"""License scans: ordered signature rules over normalised words, gated by keywords."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table
from .license_rules import SIGNATURES

#: The base phrases and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: label, the names by which texts call the license (as regular expressions over lower-case words), and
#: the versions that a text may add. A name without a version has the label without one (apache, gpl).
FAMILIES = (
    ("mit", ("mit", "mit x11", "expat"), ()),
    ("apache-2", ("apache", "apache software", "asl"), ("2 0", "2")),
    ("apache-1.1", ("apache", "apache software"), ("1 1",)),
    ("gpl-3", ("gnu general public", "gnu gpl", "gpl"), ("3 0", "3", "3 or later")),
    ("gpl-2", ("gnu general public", "gnu gpl", "gpl"), ("2 0", "2", "2 or later")),
    ("lgpl-3", ("gnu lesser general public", "gnu lgpl", "lgpl"), ("3 0", "3")),
    ("lgpl-2.1", ("gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"), ("2 1", "2")),
    ("agpl-3", ("gnu affero general public", "gnu agpl", "agpl"), ("3 0", "3")),
    ("gpl-3", ("gplv3", "gpl3"), ()),
    ("gpl-2", ("gplv2", "gpl2"), ()),
    ("lgpl-3", ("lgplv3", "lgpl3"), ()),
    ("lgpl-2.1", ("lgplv2 1", "lgplv2", "lgpl2 1", "lgpl2"), ()),
    ("agpl-3", ("agplv3", "agpl3"), ()),
    ("mpl-2", ("mplv2 0", "mplv2", "mpl2 0", "mpl2"), ()),
    ("apache-2", ("apachev2", "apache2"), ()),
    ("gfdl", ("gnu free documentation", "gfdl"), ("1 1", "1 2", "1 3")),
    ("bsd-3", ("bsd 3 clause", "new bsd", "modified bsd", "revised bsd"), ()),
    ("bsd-2", ("bsd 2 clause", "simplified bsd", "freebsd"), ()),
    ("bsd", ("bsd", "berkeley software distribution"), ()),
    ("mpl-2", ("mozilla public", "mpl"), ("2 0", "2")),
    ("mpl-1.1", ("mozilla public", "mpl"), ("1 1", "1 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public",), ("1 0",)),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), ("2",)),
    ("artistic", ("artistic", "perl artistic"), ("1 0", "2 0")),
    ("boost", ("boost software", "boost"), ("1 0",)),
    ("python", ("python software foundation", "psf"), ("2",)),
    ("ofl", ("sil open font", "open font", "ofl"), ("1 1",)),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderiv[a-z]*"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderiv[a-z]*"), ("2 0", "3 0", "4 0")),
    ("cc-by", ("cc by", "creative commons attribution"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
    ("public-domain", ("public domain",), ()),
    ("proprietary", ("all rights reserved",), ()),
)

#: Words near which a name counts as a license: templates of the rules with their priority.
_TEMPLATES = (
    (90, "(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of the )?{n}(?: licen[cs]e)?{v}"),
    (80, "under (?:the )?(?:terms of the )?{n} licen[cs]e{v}"),
    (70, "{n} licen[cs]e{v}"),
    (95, "spdx license identifier {n}{v}"),
    (60, "licen[cs]e {n}{v}"),
)
#: Templates of names with a version: the version before "license", and the notice of the GNU licenses.
_VERSIONED = ((70, "(?:under (?:the )?(?:terms of the )?)?{n}{v} licen[cs]e"),)
_NOTICE = (
    90,
    "(?:(?:licensed|released|distributed|published|available|provided) )?(?:under (?:the )?(?:terms of the )?)?"
    "{n} licen[cs]e as published by the free software foundation(?: inc)?(?: either)?{v}(?: of the licen[cs]e)?",
)
#: Names that are also plain words: without a version they need "under" and "license", or SPDX.
_PLAIN = ("artistic", "boost", "common public", "open font")
#: Names that are a license by themselves, and those that are with a version.
_ALONE = (
    "cc by", "cc0", "gnu ", "creative commons", "unlicense", "wtfpl", "public domain", "all rights reserved",
    "gplv", "gpl2", "gpl3", "lgplv", "lgpl2", "lgpl3", "agplv", "agpl3", "mplv", "mpl2", "apachev2",
)
_ALONE_VERSIONED = ("gpl", "lgpl", "agpl", "gfdl", "mpl")


def _needs_own_word(pattern: str) -> bool:
    """Can the pattern match without the word license?"""
    bare = pattern
    while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", bare)) != bare:
        bare = shorter
    return "|" in re.sub(r"\([^()]*\)|\[[^]]*\]", "", pattern) or not re.search("licen", bare)


def _any_of(words: list[str]) -> str:
    """One pattern for many literal texts, which branches letter by letter: a place that fits none of them
    fails at its first letters."""
    if "" in words:
        return ""  # what is longer than a word that matches needn't be looked at
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    forms = [first + _any_of(rest) for first, rest in sorted(by.items())]
    return forms[0] if len(forms) == 1 else f"(?:{'|'.join(forms)})"


def _gate() -> str:
    """What any rule needs somewhere in the text: a word of its template, a name that the template takes
    without one, or a signature's keyword."""
    names = sorted({name.removesuffix("[a-z]*") for _, names, _ in FAMILIES for name in names})
    alone = [f" {name}" for name in names if name.startswith(_ALONE)]
    under = [f" under {more}{name}" for name in names for more in ("", "the ", "terms of the ", "the terms of the ")]
    keywords = [keyword for _, _, keyword, pattern in SIGNATURES if _needs_own_word(pattern)]
    versioned = [f" {name} {v}" for name in _ALONE_VERSIONED for v in ("version ", "v", *map(str, range(10)))]
    return f"licen[cs]e|spdx|{_any_of(sorted({*alone, *under, *keywords, *versioned}))}"


_GATE = _gate()


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern), in order: the hand-written signatures, then the templates over
    license names; a version makes a rule more specific."""
    out = {(priority, label, keyword, f" (?:{pattern})(?= )"): None for priority, label, keyword, pattern in SIGNATURES}
    for label, names, versions in FAMILIES:
        longest = sorted(versions, key=len, reverse=True)
        v = f" (?:version )?(?:v ?)?(?:{'|'.join(longest)})"
        for name in names:
            keyword = f" {name.split()[0]} "
            alone = [(50, "{n}{v}")] if name.startswith(_ALONE) else []
            if versions:
                forms = [*_TEMPLATES, *_VERSIONED, *(alone or [(50, "{n}{v}")] * (name in _ALONE_VERSIONED))]
                forms += [_NOTICE] * label.startswith(("gpl", "lgpl", "agpl"))
                for priority, form in forms:
                    out[priority + 5, label, keyword, f" {form.format(n=name, v=v)}(?= )"] = None
            forms = [*_TEMPLATES, *alone]
            if versions and name in _PLAIN:
                forms = [(90, _TEMPLATES[0][1].replace("(?: licen[cs]e)?", " licen[cs]e")), _TEMPLATES[1], _TEMPLATES[3]]
            general = re.sub("-[0-9.]+$", "", label) if versions else label
            for priority, form in forms:
                out[priority, general, keyword, f" {form.format(n=name, v='')}(?= )"] = None
    return list(out)


def _rule_array():
    """The rules by keyword: array<struct<k, rules: array<struct<p, l, r>>>>."""
    by: dict[str, list[str]] = {}
    for p, label, key, pattern in rules():
        by.setdefault(key, []).append("named_struct('p',{},'l','{}','r','{}')".format(p, label, pattern.replace("'", "''")))
    return F.expr("array({})".format(",".join(f"named_struct('k','{k}','rules',array({','.join(x)}))" for k, x in by.items())))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """Words with A-Z lower-cased, each between single spaces; no word: one space."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    plain = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _spaces(x):
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z lower-cased. Base: all places
    where a base phrase's words stand consecutively. Then the signature rules: texts without any
    gate word skip them; a rule runs only where its keyword occurs. Of two detections one of which
    contains the other that of lower priority is suppressed, of equal priority the one within, of the same
    place too the later label; the labels of the rest join the base labels. score: the highest priority kept
    over 100 (a base phrase counts 0.9); 0 without any.

    Null or empty text: no words, counts 0, first_word and last_word null, labels empty, score 0.
    Null ids, ties and repeated rows: each row stays by itself. Extra columns are ignored. Empty
    input gives no rows. Only column functions are used.
    """
    z = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("z"))
    n_words = _spaces(F.col("z")) - 1
    base = {}
    for phrase, label in BASE_PHRASES:
        gaps = F.split(F.col("z"), f" {phrase}(?= )", -1)
        base[label] = F.when(F.col("z").contains(f" {phrase} "), F.struct(
            (F.size(gaps) - 1).cast("long").alias("n"),
            _spaces(F.element_at(gaps, 1)).alias("first"),
            (n_words - (_spaces(F.element_at(gaps, -1)) - 1) - F.lit(len(phrase.split()))).alias("last"),
        ))
    place = z.select(
        "doc_id", "z", n_words.alias("n_words"), *[base[label].alias(f"b{i}") for i, (_, label) in enumerate(BASE_PHRASES)]
    )
    bs = [F.col(f"b{i}") for i in range(len(BASE_PHRASES))]
    labels = F.array_compact(F.array(*[F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(bs, BASE_PHRASES)]))
    gated = F.col("z").rlike(_GATE)
    # places of a rule's matches: the gaps between them, laid end to end
    found = place.withColumn("rules", F.when(gated, _rule_array()))
    hits = F.expr(
        """transform(filter(flatten(transform(filter(rules, g -> contains(z, g.k)), g -> g.rules)), r -> z rlike r.r), r -> named_struct(
             'p', r.p, 'l', r.l, 'gaps', split(z, r.r, -1), 'found', regexp_extract_all(z, r.r, 0)))"""
    )
    spans = F.expr(
        """flatten(transform(hits, h -> aggregate(arrays_zip(slice(h.gaps, 1, size(h.found)), h.found),
             named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,p:int,l:string>>)),
             (a, q) -> named_struct('at', a.at + length(q['0']) + length(q['found']), 'out', concat(a.out, array(named_struct(
               's', a.at + length(q['0']), 'e', a.at + length(q['0']) + length(q['found']), 'p', h.p, 'l', h.l)))),
             a -> a.out)))"""
    )
    found = found.withColumn("hits", F.when(gated, hits)).drop("rules")
    found = found.withColumn("spans", F.when(F.col("hits").isNotNull(), spans)).drop("hits")
    # from left to right, longer ones first; ``open``: those that may still contain or lie around the next
    ordered = F.expr("array_sort(transform(spans, x -> named_struct('s', x.s, 'e', -x.e, 'p', -x.p, 'l', x.l)))")
    kept = F.expr(
        """aggregate(ordered, named_struct('open', cast(array() as array<struct<e:int,p:int,l:string,stays:boolean>>),
               'l', cast(array() as array<string>), 'p', 0),
             (a, x) -> named_struct(
               'open', concat(
                 transform(filter(a.open, o -> o.e > x.s), o -> named_struct('e', o.e, 'p', o.p, 'l', o.l, 'stays', o.stays and not (o.e >= -x.e and o.p < -x.p))),
                 if(exists(a.open, o -> o.e >= -x.e and o.p >= -x.p), cast(array() as array<struct<e:int,p:int,l:string,stays:boolean>>),
                   array(named_struct('e', -x.e, 'p', -x.p, 'l', x.l, 'stays', true)))),
               'l', array_union(a.l, transform(filter(a.open, o -> o.e <= x.s and o.stays), o -> o.l)),
               'p', greatest(a.p, coalesce(array_max(transform(filter(a.open, o -> o.e <= x.s and o.stays), o -> o.p)), 0))),
             a -> named_struct('l', array_union(a.l, transform(filter(a.open, o -> o.stays), o -> o.l)),
               'p', greatest(a.p, coalesce(array_max(transform(filter(a.open, o -> o.stays), o -> o.p)), 0))))"""
    )
    found = found.withColumn("ordered", ordered).withColumn("kept", F.when(F.col("spans").isNotNull(), kept))
    own = F.coalesce(F.col("kept.l"), F.array().cast("array<string>"))
    best = F.coalesce(F.col("kept.p"), F.lit(0)) / 100.0
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        sum((F.coalesce(b["n"], F.lit(0)) for b in bs), F.lit(0).cast("long")).cast("long").alias("n_base"),
        F.least(*[b["first"] for b in bs]).cast("long").alias("first_word"),
        F.greatest(*[b["last"] for b in bs]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, own))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.when(F.size(labels) > 0, F.lit(0.9)).otherwise(F.lit(0.0)), best)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
