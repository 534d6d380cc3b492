"""Rule tables: schemas, parsing of their text form, precedence, a small seed.

A rule set is data of the user. Its text form has sections of lines; each parses
into rows of a table whose ``ord`` is the line's place, overlays first. Where two
rows define one key the first one wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Endings that ``*`` stands for in a word line.
ENDINGS = ("e", "en", "er", "es", "em", "")

#: A seed in the text form, written for this package.
SEED: dict[str, list] = {
    "nouns": [
        "Velo/n/Velos = Fahrrad/n/Fahrräder | s", "Trottoir/n/Trottoirs = Gehweg/m/Gehwege", "Entscheid/m/Entscheide = Entscheidung/f/Entscheidungen | s",
        "Spital/n/Spitäler = Krankenhaus/n/Krankenhäuser | s", "Poulet/n/Poulets = Hähnchen/n/Hähnchen", "Rüebli/n/Rüebli = Möhre/f/Möhren",
        "Estrich/m/Estriche = Dachboden/m/Dachböden | auf", "Offerte/f/Offerten = Angebot/n/Angebote | s", "Billett/n/Billette,Billetts = Fahrkarte/f/Fahrkarten",
        "Randen/p/- = Rot+ Bete/f/-", "Bub/m/Buben = Junge/m/Jungen | sw gw",
    ],
    "words": ["allfällig*>etwaig*", "zügig,speditiv>rasch", "grillieren>grillen", "Merci>Danke"],
    "predicative": ["pressiert>in Eile"],
    "phrases": ["es hat mich gefreut>es war mir eine Freude", "ab sofort>sofort"],
    "verbs": ["parkier|park|ge", "grillier|grill|ge"],
    "compounds": ["velo|Fahrrad|velour", "spital|Krankenhaus|"],
    "ambiguous": ["Sack>Tüte"],
    "cues": ["estrich|Keller|Boden|Möbel~Zement|Beton", "sack|Einkauf|Papier~Schlaf"],
    "ss": ["strass!", "gross!grosso", "fuss!fusseln", "heiss!", "weiss!", "aussen!draussenx"],
    "ss_keep": ["dass", "muss", "masse", "wasser", "klasse", "kasse", "passen"],
    "ss_words": ["Buss>Buß"],
    "ss_case": ["mass|Maß|mass"],
    "ss_cues": ["masse|Meter|Breite~Menge|Leute"],
    "separable": ["finite|zügle|ziehe", "finite|zügelt|zieht", "participle|gezügelt|umgezogen", "aux|habe|bin", "aux|hat|ist", "aux|haben|sind"],
    "syntax": ["position|bin|habe", "position|ist|hat", "position|sind|haben", "participle|gesessen|", "participle|gestanden|", "adjective|gelegen|", "exists|hat|gibt", "exists|hatte|gab", "fronted|frei|", "place|Ort|", "place|Stadt|"],
    "german_too": ["Estrich", "Sack"],
}


@dataclass
class Noun:
    """One noun with its replacement: lemmas, genders (p: plural only), plurals and flags."""

    ord: int
    lemma: str
    gender: str
    plurals: list[str]
    words: list[str]
    target: str
    target_gender: str
    target_plural: str | None
    weak: bool = False
    target_weak: bool = False
    genitive: str | None = None
    on: bool = False
    invariant: bool = False
    suffix: bool = False
    unless: str | None = None

    @classmethod
    def parse(cls, line: str, ord: int) -> Noun:
        body, _, tail = line.partition(" | ")
        own, other = (side.split("/") for side in body.split(" = "))
        *words, target = other[0].split(" ")
        flags = dict(f.partition("=")[::2] for f in tail.split())
        plurals = [own[0]] if own[1] == "p" else [p for p in own[2].split(",") if p != "-"]
        plural = target if other[1] == "p" else None if other[2] == "-" else other[2]
        return cls(ord, own[0], own[1], plurals, words, target, other[1], plural, "sw" in flags, "gw" in flags, flags.get("gen"), "auf" in flags, "inv" in flags, "s" in flags, flags.get("x"))

    def forms(self) -> list[str]:
        """Every surface form, longest first."""
        out = dict.fromkeys([] if self.gender == "p" else [self.lemma])
        if self.gender in "mn":
            out |= dict.fromkeys([self.lemma + "s", self.lemma + "es"])
        if self.weak:
            out[self.lemma + ("n" if self.lemma.endswith("e") else "en")] = None
        for p in self.plurals:
            out[p] = None
            if p[-1] not in "ns":
                out[p + "n"] = None
        return sorted(out, key=lambda f: (-len(f), f))


def word_pairs(line: str) -> list[tuple[str, str]]:
    """``a,b>c,d`` as pairs; the last replacement serves all that remain, ``*`` takes each ending."""
    left, right = (side.split(",") for side in line.split(">"))
    out = []
    for i, key in enumerate(left):
        new = right[min(i, len(right) - 1)]
        out += [(key[:-1] + e, new[:-1] + e) for e in ENDINGS] if key.endswith("*") else [(key, new)]
    return out


def cue(line: str) -> tuple[list[str], str | None, str | None]:
    """``a,b|pro|pro~contra|contra``: forms, pattern for, pattern against."""
    keys, _, rest = line.partition("|")
    pro, _, contra = rest.partition("~")
    return keys.split(","), pro or None, contra or None


@dataclass
class RuleSet:
    """Parsed rules as plain rows, overlay before base, first definition kept."""

    nouns: list[Noun] = field(default_factory=list)
    exact: dict[str, str] = field(default_factory=dict)
    predicative: dict[str, str] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)
    verbs: list[tuple[str, str, str]] = field(default_factory=list)
    compounds: list[tuple[str, str, str | None]] = field(default_factory=list)
    ambiguous: dict[str, str] = field(default_factory=dict)
    cues: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    ss: list[tuple[str, str | None]] = field(default_factory=list)
    ss_keep: set[str] = field(default_factory=set)
    ss_words: dict[str, str] = field(default_factory=dict)
    ss_case: dict[str, tuple[str, str]] = field(default_factory=dict)
    ss_cues: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    separable: dict[str, dict[str, str]] = field(default_factory=dict)
    syntax: dict[str, dict[str, str]] = field(default_factory=dict)
    german_too: set[str] = field(default_factory=set)

    @classmethod
    def parse(cls, *layers: Mapping[str, Iterable[str]]) -> RuleSet:
        """The layers' rules; an earlier layer takes precedence."""
        out = cls()
        seen: set[str] = set()
        for layer in layers:
            get = lambda k, layer=layer: layer.get(k, ())
            for line in get("nouns"):
                noun = Noun.parse(line, len(out.nouns))
                if noun.lemma not in seen:
                    seen.add(noun.lemma)
                    out.nouns.append(noun)
            for name in ("words", "predicative", "phrases", "ambiguous", "ss_words"):
                into = out.exact if name == "words" else getattr(out, name)
                for line in get(name):
                    for k, v in word_pairs(line):
                        into.setdefault(k, v)
            out.verbs += [tuple(line.split("|")) for line in get("verbs")]
            out.compounds += [(h, r, x or None) for h, r, x in (line.split("|") for line in get("compounds"))]
            out.ss += [(s, x or None) for s, _, x in (line.partition("!") for line in get("ss"))]
            out.ss_keep |= set(get("ss_keep"))
            out.german_too |= set(get("german_too"))
            for line in get("ss_case"):
                form, upper, lower = line.split("|")
                out.ss_case.setdefault(form, (upper, lower))
            for name in ("cues", "ss_cues"):
                for line in get(name):
                    keys, pro, contra = cue(line)
                    for k in keys:
                        getattr(out, name).setdefault(k, (pro, contra))
            for name in ("separable", "syntax"):
                for line in get(name):
                    kind, key, value = line.split("|")
                    getattr(out, name).setdefault(kind, {}).setdefault(key, value)
        return out

    # tables

    def pairs(self, spark: SparkSession, name: str) -> DataFrame:
        """``surface``, ``repl``, ``ord`` of one section of replacements."""
        rows = [(k, v, i) for i, (k, v) in enumerate(getattr(self, name).items())]
        return spark.createDataFrame(rows, "surface string, repl string, ord int")

    def noun_forms(self, spark: SparkSession) -> DataFrame:
        """``form``, ``entry``, ``rank`` (longest first), ``lemma``, ``target``, ``target_plural``, ``plural``, ``suffix``, ``unless``."""
        rows = [(f, n.ord, i, n.lemma, n.target, n.target_plural, any(f in (p, p + "n") for p in n.plurals), n.suffix, n.unless) for n in self.nouns for i, f in enumerate(n.forms())]
        return spark.createDataFrame(rows, "form string, entry int, rank int, lemma string, target string, target_plural string, plural boolean, suffix boolean, unless string")

    def compound_heads(self, spark: SparkSession) -> DataFrame:
        rows = [(h, r, x, i) for i, (h, r, x) in enumerate(self.compounds)]
        return spark.createDataFrame(rows, "head string, repl string, unless string, ord int")
