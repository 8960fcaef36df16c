"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that end a phrase (an n-gram never spans one; hyphens are not among
# them), and the shape of a token.
BREAKS = r"""[.,;:!?()\[\]{}<>"“”`/\\|\n\r\t]+"""
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
BARE_WORD = "[a-z]+"

# English function words.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has
hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in
into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours
ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them
themselves then there there's these they they'd they'll they're they've this those through to too under until up very was
wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with
won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()
# Words that the instrument's own prompt puts into answers.
PROMPT_ECHO = ["user", "a", "a's", "users"]
#: At which n-gram sizes each mode drops function words.
STOPWORD_MODES = {"unigrams": (1,), "all": (1, 2), "none": ()}


def segments(text: Column) -> Column:
    """array<array<string>>: lower-case tokens, split where a phrase ends; null gives none."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))
    parts = F.transform(F.split(low, BREAKS), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)))
    return F.filter(parts, lambda t: F.size(t) > 0)


def ngrams(text: Column, n: int = 1, drop_stopwords: bool = False, extra: list[str] | None = None) -> Column:
    """Distinct n-grams of one text. Words are dropped before neighbours are formed."""
    drop = sorted({*(STOPWORDS if drop_stopwords else ()), *(extra or ())})
    parts = segments(text)
    if drop:
        banned = F.array(*map(F.lit, drop))
        parts = F.transform(parts, lambda t: F.filter(t, lambda w: ~F.array_contains(banned, w)))

    def grams(tokens: Column) -> Column:
        # sequence(0, -1) would count down, so short segments are left out first
        at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
        return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(parts, grams)))


def bare_words(text: Column) -> Column:
    """Runs of a-z of the lower-case text, repeated as they occur (the marked-words tokenizer)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(BARE_WORD), F.lit(0))


def label_text(label: Column, description: Column, field: str = "both") -> Column:
    """The text a term count runs on; both parts are joined so that no n-gram straddles them."""
    if field == "assumption":
        return F.coalesce(label, F.lit(""))
    if field == "description":
        return F.coalesce(description, F.lit(""))
    return F.concat_ws(". ", F.coalesce(label, F.lit("")), F.coalesce(description, F.lit("")))


def clean_turns(messages: Column) -> Column:
    """User and assistant turns with content, same-role neighbours merged, opening assistant turns dropped."""
    kind = "array<struct<role:string,content:string>>"
    kept = F.filter(
        F.transform(F.coalesce(messages, F.array().cast(kind)), lambda m: F.struct(F.lower(m["role"]).alias("role"), F.trim(F.coalesce(m["content"], F.lit(""))).alias("content"))),
        lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""),
    )

    def fold(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(m["role"].alias("role"), F.concat(last["content"], F.lit("\n\n"), m["content"]).alias("content"))))
        return F.when(last["role"] == m["role"], merged).otherwise(F.concat(acc, F.array(m))).cast(kind)

    merged = F.aggregate(kept, F.array().cast(kind), fold)
    return F.when(F.try_element_at(merged, F.lit(1))["role"] == "assistant", F.slice(merged, F.lit(2), F.greatest(F.size(merged) - 1, F.lit(0)))).otherwise(merged)


def transcript_text(messages: Column) -> Column:
    """"User: ... / AI: ..." lines of a transcript."""
    name = lambda r: F.when(r == "user", "User").when(r == "assistant", "AI").otherwise(r)
    return F.array_join(F.transform(messages, lambda m: F.concat(name(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def role_text(messages: Column, role: str = "user") -> Column:
    """The contents of one role's turns, joined by line ends."""
    own = F.filter(messages, lambda m: (m["role"] == role) & m["content"].isNotNull())
    return F.array_join(F.transform(own, lambda m: m["content"]), "\n")


def strip_think(text: Column) -> Column:
    """A completion without its <think> part, closed or cut off."""
    rest = F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", "")
    return F.regexp_replace(rest, r"(?U)^\s+|\s+$", "")


def clean_topic_label(text: Column) -> Column:
    """First line of a generated label, without quotes, marks and a leading "Topic:"."""
    first = F.element_at(F.split(strip_think(text), r"[\r\n]"), 1)
    bare = F.regexp_replace(first, r"""^[\s"'*`#-]*(?i:(?:topic|label)\s*:)?\s*|[\s"'*`.]+$""", "")
    return F.substring(bare, 1, 60)


def short_label(text: Column, most: int = 28) -> Column:
    """A label cut to a length, at a word's end where there is one, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(text, 1, most - 1)), F.lit("…")))


def plain_name(text: Column) -> Column:
    """A name reduced to lower-case letters and digits, as it is compared."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def judge_score(text: Column) -> Column:
    """The first lone digit 1 to 5 of a judge's answer, else null."""
    return F.regexp_extract(text, r"\b([1-5])\b", 1).try_cast("int")


def number_of(text: Column) -> Column:
    """0.4, "40%" or 40 as a share between 0 and 1, else null."""
    bare = F.trim(F.regexp_replace(text.cast("string"), r"""^[\s"']+|[\s"']+$""", ""))
    percent = bare.rlike(r"^\d*\.?\d+\s*%$")
    plain = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(percent, F.regexp_replace(bare, r"\s*%$", "").try_cast("double") / 100).when(plain, bare.try_cast("double"))
    scaled = F.when((value > 1) & (value <= 100), value / 100).otherwise(value)
    return F.when((scaled >= 0) & (scaled <= 1), scaled)
