"""Prompt texts as columns, and a pluggable generator with a deterministic offline stand-in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import mock_completion
from ..schema import ATTEMPT, DIMENSIONS


def open_prompt(post: Column, history: Column | None, n: int) -> Column:
    """Asks for n assumptions with probabilities as JSON, then a reply under its heading."""
    ask = f'Before you reply, state {n} assumptions about User A as JSON {{"mental_models": [{{"model_name": ..., "description": ..., "probability": ...}}]}}, most likely first, then write RESPONSE: and your reply.'
    before = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("Conversation so far:\n"), history, F.lit("\n\n"))).otherwise("") if history is not None else F.lit("")
    return F.concat(before, F.lit("User A: "), F.coalesce(post, F.lit("")), F.lit("\n\n" + ask))


def structured_prompt(post: Column, dimensions: tuple[str, ...] = DIMENSIONS, reply: bool = True) -> Column:
    """Asks for a score between 0 and 1 and an explanation per dimension, and perhaps a reply."""
    fields = ", ".join(f'"{d}": {{"score": ..., "explanation": ...}}' for d in dimensions)
    tail = " Then write RESPONSE: and your reply." if reply else " Return nothing else."
    return F.concat(F.lit("User A: "), F.coalesce(post, F.lit("")), F.lit(f'\n\nRate your beliefs about User A as JSON {{"mental_model": {{"beliefs": {{{fields}}}}}}}, scores from 0 to 1.{tail}'))


SUPPORT_TYPES = ("emotional", "informational", "tangible", "esteem", "companionship")
VERSIONS = ("plain", "explicit")


@dataclass(frozen=True)
class ProbeSpec:
    """An instrument: ``openended`` with its number of assumptions, ``4dims`` or ``supporttypes``."""

    kind: str
    n: int = 3
    version: str = "explicit"

    def __post_init__(self) -> None:
        if self.kind not in ("openended", "4dims", "supporttypes"):
            raise ValueError(f"unknown instrument {self.kind!r}")
        if self.version not in VERSIONS or self.n < 1:
            raise ValueError("unknown version, or no assumption asked for")

    @property
    def name(self) -> str:
        return f"openended-{self.n}" if self.kind == "openended" else self.kind

    @property
    def dimensions(self) -> tuple[str, ...]:
        return {"4dims": DIMENSIONS, "supporttypes": SUPPORT_TYPES}.get(self.kind, ())


def probe_prompt(spec: ProbeSpec, post: Column, history: Column | None, reply: bool = True) -> Column:
    """The prompt column of an instrument; without ``reply`` it only asks for labels."""
    if spec.kind == "openended":
        return open_prompt(post, history, spec.n)
    asked = structured_prompt(post, spec.dimensions, reply)
    if spec.version == "plain":
        asked = F.replace(asked, F.lit(", scores from 0 to 1"), F.lit(""))
    if history is None:
        return asked
    return F.concat(F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("Conversation so far:\n"), history, F.lit("\n\n"))).otherwise(""), asked)


def deployment_messages(messages: Column, post: Column, question: Column) -> Column:
    """A person's own chat with the post and a question as its last user turn; a chat that ends with
    a user turn has them added to it, so that roles alternate."""
    kind = "array<struct<role:string,content:string>>"
    turns = F.coalesce(messages, F.array().cast(kind))
    asked = F.concat(F.rtrim(post), F.lit("\n\n"), F.trim(question))
    last = F.try_element_at(turns, F.lit(-1))
    user = lambda text: F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).cast(kind)
    joined = F.concat(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), user(F.concat(F.rtrim(last["content"]), F.lit("\n\n"), asked)))
    return F.when(last["role"] == "user", joined).otherwise(F.concat(turns, user(asked)))


class Transient(Exception):
    """An error that a later try may not meet: a busy or unreachable service."""


def retrying(generator: Callable[[str], str], tries: int = 4, wait: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A generator that tries again after transient errors, each time waiting up to twice as long
    (a share of it by the prompt's hash, so that workers do not meet); other errors pass at once."""

    def run(prompt: str) -> str:
        for k in range(tries):
            try:
                return generator(prompt)
            except (Transient, TimeoutError, ConnectionError):
                if k + 1 == tries:
                    raise
                share = int(hashlib.sha256(f"{k}|{prompt}".encode()).hexdigest()[:8], 16) / 2**32
                sleep(min(most, wait * 2**k) * (0.5 + share / 2))
        raise ValueError("no try was allowed")

    return run


def attempt_rows(cells: DataFrame, constants: dict[str, object]) -> DataFrame:
    """Cells as rows of an attempt log: the log's fields, constants filled in, missing ones null."""
    fields = [f for f in ATTEMPT.fields]
    value = lambda f: F.lit(constants[f.name]) if f.name in constants else F.col(f.name) if f.name in cells.columns else F.lit(None)
    return cells.select(*[value(f).cast(f.dataType).alias(f.name) for f in fields])


def generate(df: DataFrame, prompt: str, output: str = "raw", generator: Callable[[str], str] = mock_completion) -> DataFrame:
    """Add a completion per row from any ``prompt -> text`` function, batch by batch.

    An exception becomes the row's ``error`` and an empty completion, so that a later
    attempt can supersede it.
    """
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, errors = [], []
            for p in pdf[prompt]:
                try:
                    texts.append(generator(p))
                    errors.append("")
                except Exception as e:  # noqa: BLE001 - the row keeps it
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[columns].assign(**{output: texts, "error": errors})

    from ..session import ship

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.drop("error").mapInPandas(run, f"{schema}, {output} string, error string") if "error" not in df.columns else generate(df.drop("error"), prompt, output, generator)


def fan_out(df: DataFrame, key: list[str], columns: list[str], dimensions: list[str]) -> DataFrame:
    """One judging task per response column and dimension (an unpivot and an explode)."""
    long = df.unpivot([F.col(k) for k in key], [F.col(c) for c in columns], "response_column", "response")
    return long.filter("response is not null").withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
