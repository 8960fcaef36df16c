"""Broken prompt and response pairs, each with one kind of defect.

A suffix automaton of the prompt's words is traversed with the response, which measures how
much of the response is taken from the prompt, and whether in one piece. An automaton over
classes of words (who speaks, what denies, what was asked for) finds refusals, function words
vote for the languages of both sides, and the cut-off test of :mod:`truncation` (with its
stack of open delimiters) marks what breaks off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import trimmed
from .truncation import cut_values

WORDS = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{N}’']--[\p{Han}\p{Hiragana}\p{Katakana}]]+")
PLAIN_WORDS = re.compile(r"[a-z0-9']+")
#: Matches of fewer words say nothing about copying.
LEAST_MATCH = 6
COPIED_SHARE = 0.6
#: Matched words over the stretch of prompt they lie in: copies come in one piece.
PIECE_SHARE = 0.6
LONG_MATCH = 16
#: A refusal comes first: it starts in one of so many sentences.
FIRST_SENTENCES = 3
#: Words of a clause before the refusal, such as "unfortunately" or "as an AI".
LEAD = 4

# Placeholders that stand for no reply.
PLACEHOLDERS = frozenset(
    ("response", "reply", "answer", "null", "none", "nil", "na", "undefined", "empty", "n a")
    + ("no response", "no reply", "no answer", "not available", "no content")
)

# Classes of words that refusals are made of, in several languages.
CLASSES = {
    "self": "i we ich je yo eu io я ik",
    "can": "can will am are able allowed permitted going position",
    "not": "not unable never",
    "rather": "rather prefer choose choosing chose",
    "decline": "decline refuse abstain pass declining refusing abstaining",
    "direct": "assist answer comment advise comply respond reply discuss engage weigh opine participate help",
    "directing": "assisting answering commenting advising complying responding replying discussing engaging weighing participating helping",
    "give": "give provide offer take express make form", "giving": "giving providing offering taking expressing making forming",
    "object": "advice opinion opinions view views guidance answer reply response recommendation sides side position stance assistance help comment judgement judgment verdict",
    "between": "be able to going allowed permitted in a position currently really just personally at this time of any comfortable",
    "finish": "fulfill fulfil complete completed process processed continue continuing granted answered handled",
    "asked": "request question topic subject matter message prompt query",
    "leave": "leave skip avoid decline pass",
    "outside": "outside beyond against violates exceeds",
    "bounds": "guidelines policy policies programming rules instructions allowed permitted scope remit purpose capabilities able",
    "rules": "guidelines policy policies programming rules instructions",
    "forbid": "not prevent prevents forbid forbids prohibit prohibits",
    "model": "ai model assistant chatbot bot",
    "artificial": "ai language machine artificial virtual",
    "as": "as just only merely",
    "no": "no not unable cannot lack without",
    "something": "something anything",
    "declined": "declined refused rejected blocked",
    "no_": "no",
    "on": "on about from regarding concerning",
    "es_no": "no", "es_can": "puedo podemos prefiero voy", "es_ask": "ayudar ayudarte ayudarle ayudarles responder responderte opinar comentar contestar asistir asistirte aconsejar",
    "fr_not": "ne", "fr_can": "peux peut pouvons préfère souhaite suis", "fr_ask": "aider répondre prononcer commenter conseiller discuter assister",
    "de_can": "kann möchte darf können", "de_not": "nicht nichts kein keine", "de_ask": "helfen beantworten äußern sagen antworten unterstützen kommentieren raten weiterhelfen beraten",
    "pt_no": "não nao", "pt_can": "posso podemos prefiro consigo", "pt_ask": "ajudar ajudá-lo ajudar-te responder opinar comentar aconselhar",
    "it_no": "non", "it_can": "posso possiamo preferisco", "it_ask": "aiutarti aiutarla aiutare rispondere rispondervi esprimermi commentare consigliare",
    "ru_no": "не", "ru_can": "могу можем предпочитаю буду", "ru_ask": "помочь ответить отвечать комментировать обсуждать советовать",
    "nl_can": "kan wil mag", "nl_not": "niet geen", "nl_ask": "helpen beantwoorden antwoorden reageren adviseren",
}
# The orders in which classes refuse; a number is how many other words may stand before the next class,
# after a tilde only those of the class "between".
ORDERS = """
self 0 can 1 not ~6 direct|self 0 can 1 not ~6 give 4 object|self 0 can 1 not ~6 finish|self 2 not 1 comfortable 0 directing|self 2 not 1 comfortable 0 giving 4 object
self 1 rather 0 not ~2 direct|self 1 rather 0 not ~2 give 4 object|self 3 decline 1 to|self 3 decline 0 on|self 3 decline
outside 3 bounds|rules 1 forbid|asked 1 can 0 not 1 be|asked 2 declined|asked 1 self 1 can 2 leave|asked 3 self 0 can 1 not|not 0 something 2 self 1 can
as 1 artificial 1 model 6 no|as 1 artificial 3 self 1 can 1 not|as 1 model 3 self 1 can 1 not|self 3 artificial 0 model 6 no|no_ 0 object 0 on
es_no 0 es_can 3 es_ask|es_can 0 es_no 2 es_ask|fr_not 0 fr_can 5 fr_ask|fr_can 0 fr_not 3 fr_ask|de_can 4 de_not 2 de_ask|pt_no 0 pt_can 3 pt_ask|pt_can 0 pt_no 2 pt_ask
it_no 0 it_can 3 it_ask|it_can 0 it_no 2 it_ask|ru_no 0 ru_can 3 ru_ask|ru_can 0 ru_no 2 ru_ask|nl_can 4 nl_not 2 nl_ask
""".strip().replace("\n", "|").split("|")
# How a denial goes on when it does not refuse, and how a reply goes on to help.
IDIOM = re.compile(r"\bnot help (?:but|feeling|wondering|thinking|noticing|smiling|it)\b|\bnot (?:offer|give|take|make) (?:enough|up|away|sure)\b")
HELPS_ON = re.compile(r"\b(?:but|however|still|instead) (?:i (?:can|could|will|am able)(?! not)|here|let|you (?:can|could|might)|what i can)\b")
# Refusals of languages without spaces.
UNSPACED = re.compile(r"(?:手伝い|お答え|回答|コメント|支援|お応え)[^。]{0,8}(?:できません|控え|かねます)|(?:无法|不能|不便|無法)[^。]{0,6}(?:帮助|回答|提供|评论|协助|幫助|評論)")
# Spellings of negations and short forms, one word a part.
SHORT = [(re.compile(p), r) for p, r in ((r"\bcannot\b", "can not"), (r"\bcan't\b", "can not"), (r"\bwon't\b", "will not"), (r"n't\b", " not"), (r"'m\b", " am"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'re\b", " are"))]
QUOTED = re.compile(r"“[^”]*”|\"[^\"]*\"")
CLAUSE = re.compile(r"[.!?:;\n()*…。！？—]+|(?:^|[\s,])(?:but|so|therefore|aber|pero|mais|ma|mas|но)(?=\s)")
SENTENCE = re.compile(r"[.!?…。！？\n]+")

# Frequent function words of each language.
STOPWORDS = {
    "en": "the and you your that to of is it a in was for with but what they have not this be are on as so when from i my would how who than if me we there their will at by or an do can could should",
    "es": "el la los las que de y en un una por con para tu mi lo se no es muy pero cuando desde después antes también ya ha había hizo fue me su al del como más si porque sin sobre este esta eso te le nos hay son está estás ser sus yo ella",
    "de": "der die das und ich du ist nicht ein eine mit auf für von zu dem den des dass es war nach vor haben hat dein deine mein meine wegen auch wenn noch ob über alle sie er wir im am bei aus wie so aber oder als man nur wird sich einen einer",
    "fr": "le la les et je tu est que de des un une ne pas pour avec ce sur mais dans du au à ta ton ma mon après avant même tout il y nous était qui se sa son ses vous elle ils par plus ou où si leur cette ces été aux sans comme",
    "pt": "o a os as que de e em um uma por com para seu sua não é mas do da no na foi ser depois antes ainda minha meu sobre dos das ao à se ele ela você como mais ou quando muito já também nos são está isso este esta pelo pela sem",
    "it": "il la lo gli le che di e in un una per con non è ma del della tua tuo mia mio sono prima dopo anche molto quando tu su ha era se al dei delle nel nella si come più o ci ti mi questo questa suo sua loro da dal alla cui sei",
    "nl": "de het een en van ik je dat niet is in op te met voor aan zijn er maar om dan ook als bij nog wel naar uit door over hij ze was heeft mijn jouw deze dit geen",
    "ru": "и в не на что я ты с это как но по от из за для мой твоя уже был была после перед мы он она они так же бы если или к у о",
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _VOTES.setdefault(_w, []).append(_lang)
KANA, HAN, CYRILLIC, HANGUL = (regex.compile(rf"\p{{{s}}}") for s in ("Hiragana", "Han", "Cyrillic", "Hangul"))
PREAMBLE = re.compile(r"(?i)^\s*(?:okay|ok|sure|of course|certainly)?[,.! ]*(?:here(?:'s| is) (?:my|the|your) (?:reply|answer|response)|you (?:wrote|said|asked)|response|reply|answer)\s*:\s*")


def words(text: str | None) -> list[str]:
    """Lower-case words without quotes' direction; ideographs and kana singly."""
    if text is None:
        return []
    return PLAIN_WORDS.findall(text.lower()) if text.isascii() else WORDS.findall(text.lower().replace("’", "'"))


def language(text: str | None, tokens: list[str] | None = None) -> str | None:
    """The language most stop words vote for; scripts decide where they can; null if unclear."""
    if not text:
        return None
    if not text.isascii():
        letters = sum(c.isalpha() for c in text)
        kana, han, cyr, hang = (len(p.findall(text)) for p in (KANA, HAN, CYRILLIC, HANGUL))
        if letters and kana + han + hang > 0.3 * letters:
            return "ja" if kana else "ko" if hang > han else "zh"
        if letters and cyr > 0.3 * letters:
            return "ru"
    votes: dict[str, float] = {}
    for w in words(text) if tokens is None else tokens:
        for lang in (own := _VOTES.get(w, ())):
            votes[lang] = votes.get(lang, 0.0) + 1 / len(own)
    if not votes:
        return None
    ranked = sorted(votes.items(), key=lambda x: (-x[1], x[0]))
    runner = ranked[1][1] if len(ranked) > 1 else 0.0
    return ranked[0][0] if ranked[0][1] >= 1.5 and ranked[0][1] > 1.25 * runner else None


class PromptAutomaton:
    """Suffix automaton of one prompt's words, with a place where each state ends."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for i, c in enumerate(tokens):
            cur = self._state(self.length[last] + 1, i + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    copy = self._state(self.length[p] + 1, self.end[q])
                    self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def _state(self, length: int, end: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.link) - 1

    def matches(self, tokens: list[str], least: int) -> list[tuple[int, int, int]]:
        """(start in response, words, start in prompt) of the longest matches, left to right."""
        state = matched = 0
        run: list[tuple[int, int]] = []
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            run.append((matched, self.end[state]))
        out, i = [], len(tokens)
        while i > 0:
            n, end = run[i - 1]
            if n >= least:
                out.append((i - n, n, end - n))
                i -= n
            else:
                i -= 1
        return out[::-1]


@lru_cache(maxsize=256)
def _prompt(text: str) -> tuple[list[str], dict[int, set], list]:
    """A prompt's words, its sets of runs by length, and (when asked for) its automaton."""
    return words(text), {}, []


def _runs(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def is_copy(response: list[str], prompt: str) -> bool:
    """Whether a good part of the response is taken from the prompt, in its order.

    The runs and the automaton of a prompt are kept for its other responses, which come
    next to each other.
    """
    asked, runs, automaton = _prompt(prompt)
    if len(response) < 4 or len(asked) < 4:
        return False
    least = min(LEAST_MATCH, len(response), len(asked))
    if least not in runs:
        runs[least] = _runs(asked, least)
    if runs[least].isdisjoint(_runs(response, least)):
        return False
    if not automaton:
        automaton.append(PromptAutomaton(asked))
    found = automaton[0].matches(response, least)
    total = sum(n for _, n, _ in found)
    longest = max((n for _, n, _ in found), default=0)
    if total < COPIED_SHARE * len(response) and longest < 2 * LONG_MATCH:
        return False
    # The stretch of prompt that the matches lie in: alike in length, if it is one piece.
    stretch = max(p + n for _, n, p in found) - min(p for _, _, p in found)
    return longest >= LONG_MATCH or total >= PIECE_SHARE * stretch and (total >= 0.8 * len(response) and total >= 10 or total >= 0.9 * len(asked))


class RefusalAutomaton:
    """A non-deterministic automaton over word classes: each order is a chain of states, and a
    state waits some words for the next class of its order."""

    def __init__(self, orders: list[str], classes: dict[str, str]):
        self.member: dict[str, set[str]] = {}
        for name, listed in classes.items():
            for w in listed.split():
                self.member.setdefault(w, set()).add(name)
        self.chains = []
        for order in orders:
            parts = order.split()
            self.chains.append((parts[0::2], [(int(g.lstrip("~")), g[0] == "~") for g in parts[1::2]]))
        for names, _ in self.chains:  # a name without a list is a word of its own
            for n in names:
                if n not in classes:
                    self.member.setdefault(n, set()).add(n)
        self.first: dict[str, list[int]] = {}
        for i, (names, _) in enumerate(self.chains):
            self.first.setdefault(names[0], []).append(i)

    def accepts(self, clause: list[str]) -> bool:
        """Whether an order begins near the clause's start and is gone through."""
        active: dict[tuple[int, int], int] = {}
        for at, w in enumerate(clause):
            own, now = self.member.get(w, ()), {}
            for (chain, state), patience in active.items():
                names, gaps = self.chains[chain]
                if names[state] in own:
                    if state + 1 == len(names):
                        return True
                    now[chain, state + 1] = gaps[state][0]
                if patience and (not gaps[state - 1][1] or "between" in own):
                    now[chain, state] = max(patience - 1, now.get((chain, state), 0))
            if at < LEAD:
                for name in own:
                    for chain in self.first.get(name, ()):
                        names, gaps = self.chains[chain]
                        if len(names) == 1:
                            return True
                        now[chain, 1] = max(gaps[0][0], now.get((chain, 1), 0))
            active = now
            if not active and at >= LEAD:
                return False
        return False


REFUSAL = RefusalAutomaton(ORDERS, CLASSES)
#: Every order holds a word of these classes, so a text without any is let go at once.
DENIES = frozenset(w for c in CLASSES if c in ("not", "rather", "decline", "outside", "forbid", "declined", "leave", "no") or c.endswith(("_no", "_not")) for w in CLASSES[c].split())
WORD = re.compile(r"[\w\-]+")


def is_refusal(text: str, tokens: list[str] | None = None) -> bool:
    """Whether a reply turns the request down: near the start of a clause of its first
    sentences, in its own words (quoted ones are another's), and without going on to help."""
    low = text.lower().replace("’", "'")
    if not low.isascii() and UNSPACED.search(low):
        return True
    if DENIES.isdisjoint(re.findall(r"\w+", low) if tokens is None else tokens) and "n't" not in low:
        return False
    if "“" in low or '"' in low:
        bare = QUOTED.sub(" ", low)
        low = bare if WORD.search(bare) else low
    first: list[str] = []
    at = 0
    for m in SENTENCE.finditer(low):
        if WORD.search(low, at, m.start()):
            first.append(low[at : m.start()])
        at = m.end()
        if len(first) == FIRST_SENTENCES:
            break
    else:
        first.append(low[at:])
    for sentence in first:
        if DENIES.isdisjoint(WORD.findall(sentence)) and "n't" not in sentence:
            continue
        if "'" in sentence or "cannot" in sentence:
            for p, r in SHORT:
                sentence = p.sub(r, sentence)
        if HELPS_ON.search(sentence) or IDIOM.search(sentence):
            continue
        if any(REFUSAL.accepts(WORD.findall(c)) for c in CLAUSE.split(sentence)):
            return True
    return False


def defect(response: str | None, prompt: str | None, other: str | None, cut: bool) -> str | None:
    """The one defect of a reply, or null: empty, copied, refusal, other_language, truncated.

    ``prompt`` may be unknown; ``other`` is another wording of it that tells its language.
    """
    tokens = words(response)
    if not tokens or " ".join(tokens) in PLACEHOLDERS:
        return "empty"
    bare = PREAMBLE.sub("", response)
    own = words(bare)
    if not own:
        return "empty"
    if prompt and is_copy(own, prompt):
        return "copied"
    if is_refusal(bare, own):
        return "refusal"
    spoken, asked = language(bare, own), _asked(prompt) or _asked(other)
    if spoken and asked and spoken != asked:
        return "other_language"
    return "truncated" if cut else None


@lru_cache(maxsize=256)
def _asked(text: str | None) -> str | None:
    return language(text)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, *rest = batch.columns
        out = [defect(*row) for row in zip(*(c.to_pylist() for c in rest))]
        yield pa.RecordBatch.from_arrays([key, pa.array(out, pa.string())], names=["key", "defect"])


def broken_pairs(responses: DataFrame, prompts: DataFrame, key: str, text: str, source: str, prompt_key: str, prompt_kind: str, prompt_text: str, limits: DataFrame | None = None) -> DataFrame:
    """(key, defect) of each defective reply, repeated rows included, with exactly one defect.

    Replies are held against the prompt of the same cleaned key and the same kind. Null,
    blank and placeholder replies are ``empty``. Without a prompt's text nothing is copied
    and, unless its other wordings tell the language, nothing is in another one. Very long texts are read
    whole. Of several texts under one prompt the greatest counts. An empty table gives an
    empty result; other columns play no part.
    """
    cut = cut_values(responses, key, source, text, limits).select(F.col(key).alias("_cut")).distinct()
    kinds = prompts.select(trimmed(F.col(prompt_key)).alias("pid"), F.col(prompt_kind).alias("t"), F.col(prompt_text).alias("x")).filter("x is not null and pid is not null")
    texts = kinds.groupBy("pid", "t").agg(F.max("x").alias("x"))
    own = responses.select(F.col(key).alias("key"), F.col(text).cast("string").alias("r"), F.col(prompt_kind).alias("t"), trimmed(F.col(prompt_key)).alias("pid"))
    # Cuts are joined before the prompts' texts, so that those are shuffled once.
    own = own.join(cut, F.col("key") == F.col("_cut"), "left").select("key", "r", "t", "pid", F.col("_cut").isNotNull().alias("c"))
    asked = own.join(texts, ["pid", "t"], "left")
    # Replies to one prompt come together, so its automaton is built once.
    known = asked.filter("x is not null").sortWithinPartitions("pid", "t").select("key", "r", "x", F.lit(None).cast("string").alias("y"), "c")
    # Only replies without their own prompt's text look for another wording of it.
    lone = asked.filter("x is null").drop("x", "t")
    wordings = kinds.join(lone.select("pid").distinct(), "pid", "left_semi").groupBy("pid").agg(F.max("x").alias("y"))
    unknown = lone.join(wordings, "pid", "left").select("key", "r", F.lit(None).cast("string").alias("x"), "y", "c")
    kind = responses.schema[key].dataType.simpleString()
    judged = known.unionByName(unknown).mapInArrow(_judge, f"key {kind}, defect string").filter("defect is not null")
    return judged.withColumnRenamed("key", key)
