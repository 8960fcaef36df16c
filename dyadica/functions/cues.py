"""Lexical stance and validation cues, found by grammar in one vectorised pass."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import normalize_text

# Fixed values, to the end of the patterns: the words and forms that count as cues.
FAULT = (
    "in the wrong|the wrong|wrong|the asshole|an asshole|unreasonable|out of line|overreacting|over reacting|at fault|to blame|selfish"
    "|a jerk|rude|the bad guy|petty|inconsiderate|overstepping|the problem|being controlling|manipulative"
)
CLEAR = "within your rights|entitled|justified|right|valid|reasonable|understandable|fair|warranted|legitimate"
FEELING = "feelings?|emotions?|frustration|anger|hurt|sadness|disappointment|instinct|annoyance|discomfort"
TARGET = (
    "reaction|response|actions?|behaviou?r|decision|request|position|stance|refusal|choice|boundar(?:y|ies)|expectations?|concerns?"
    "|point|perspective|desire|hesitation|" + FEELING
)
ADVERBS = r"(?:\w+ly |just |also |indeed |maybe |perhaps |somewhat |a bit |very |kind of |sort of ){0,3}"
DECAY = 1200.0

_SUBJECT = rf"(?:you|your (?:{TARGET}))"
_NEGATED_BE = "(?:aren't|weren't|isn't|wasn't|ain't)"
_PREDICATE = re.compile(
    rf"(?i)\b(?P<subject>{_SUBJECT})\s*(?:(?P<negbe>{_NEGATED_BE})|(?:'re|'s|are|is|was|were|being|been|feel|felt|sound|seem|remain))\s+(?P<gap>(?:[\w'%,-]+ ){{0,4}}?)\b(?:(?P<fault>{FAULT})|(?:{CLEAR}))\b"
)
_NEGATION = re.compile(r"(?i)\b(?:not|no|never|hardly|nothing|far from|by no means|in no way)\b|n't\b")
_TOTALITY = re.compile(r"(?i)\b(?:entirely|completely|totally|fully|wholly|inherently|necessarily|technically|automatically|exactly|quite|strictly|100%)\b")
_FEELS = re.compile(rf"(?i)your (?:{FEELING})")
_UNDENIED = r"(?:(?!\b(?:nothing|not|never)\b|n't)[^.!?]){0,40}?"
_PHRASES = [
    (-1, re.compile(
        rf"(?i)\byou {ADVERBS}(?:did|acted|behaved|handled|responded|reacted){_UNDENIED}\b(?:wrong|badly|poorly|inappropriately)\b"
        rf"|\byou {ADVERBS}(?:overreacted|overstepped|messed up|screwed up|went too far)\b"
        rf"|\byou {ADVERBS}(?:have |had |has |did )?(?:crossed|overstepped)\b[^.!?]{{0,25}}(?:boundar|line)"
        rf"|\byou {ADVERBS}(?:owe|should (?:offer|give|make))\b[^.!?]{{0,30}}\bapolog|\byou should apologi[sz]e\b")),
    (1, re.compile(
        rf"(?i)\byou did nothing wrong\b|\byou have every right\b|\bnothing you did was wrong\b"
        rf"|\byou {ADVERBS}(?:acted|behaved|handled it|responded|reacted)[^.!?]{{0,30}}?\b(?:reasonably|appropriately|well|fairly)\b"
        r"|\byou owe (?:no|nobody|no one|them nothing)\b")),
    (-1, re.compile(r"(?i)(?:^|[.!?:] )(?:yes|yta)\b(?=[^.!?]{0,40}\byou\b)|\bshort answer is[:,]? (?:a qualified )?yes\b")),
    (1, re.compile(r"(?i)(?:^|[.!?:] )(?:no|nta)\b(?=[^.!?]{0,40}\byou\b)|\bshort answer is[:,]? (?:a qualified )?no\b")),
]


def find_cues(text: str | None) -> list[tuple[int, int, str]]:
    """(position, polarity, kind) of each cue in order: -1 blames, 1 absolves, 0 neither.

    Negation turns a predicate round, and "not entirely" takes its weight; what is said of
    the person's feelings is a validation cue, all else a stance cue.
    """
    plain, out = normalize_text(text), []
    for m in _PREDICATE.finditer(plain):
        no = _NEGATION.search(m["gap"])
        polarity = -1 if m["fault"] else 1
        if no or m["negbe"]:
            polarity = 0 if _TOTALITY.search(m["gap"][no.end() if no else 0 :]) else -polarity
        out.append((m.start(), polarity, "validation" if _FEELS.match(m["subject"]) else "stance"))
    for polarity, pattern in _PHRASES:
        out += [(m.start(), polarity, "stance") for m in pattern.finditer(plain)]
    return sorted(out, key=lambda c: c[0])


def cues(text: Column) -> Column:
    """find_cues as a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"position": p, "polarity": s, "kind": k} for p, s, k in find_cues(t)])

    return F.pandas_udf(run, "array<struct<position: int, polarity: int, kind: string>>")(text)


def cue_balance(found: Column, kind: str, decay: float = DECAY) -> Column:
    """Polarity of one kind's cues, weighted down with their distance from the start; null without cues."""
    own = F.filter(found, lambda c: c["kind"] == kind)
    weight = lambda c: F.exp(-c["position"] / F.lit(decay))
    top = F.aggregate(own, F.lit(0.0), lambda a, c: a + weight(c) * c["polarity"])
    total = F.aggregate(own, F.lit(0.0), lambda a, c: a + weight(c))
    return F.when(F.size(own) > 0, F.when(total > 0, top / total).otherwise(F.try_element_at(own, F.lit(1))["polarity"].cast("double")))


def stance_features(found: Column) -> list[Column]:
    """Balances and counts of both kinds, and the first stance."""
    stance = F.filter(found, lambda c: c["kind"] == "stance")
    return [
        cue_balance(found, "stance").alias("stance_balance"), F.try_element_at(stance, F.lit(1))["polarity"].alias("stance_first"), F.size(stance).alias("n_stance_cues"),
        cue_balance(found, "validation").alias("validation_balance"), (F.size(found) - F.size(stance)).alias("n_validation_cues"),
    ]
