"""Where models plug in: scorers of texts and pairs, with deterministic stand-ins.

A scorer maps a batch of inputs to a batch of outputs and is loaded once per worker.
``embedding_column`` and ``pair_column`` turn one into a column; without a model the
stand-ins below give reproducible values of the same shape.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
PairScorer = Callable[[list[str], list[str]], np.ndarray]
PAIR = "entailment_probability double, contradiction_probability double, verifier_label string"


def hashed_embedder(dimensions: int = 64, normalize: bool = True) -> Embedder:
    """Bag of hashed words: the digest of a word names its place (first four hexadecimal digits) and its sign (the fifth)."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = hashlib.md5(word.encode("utf-8", "replace")).hexdigest()
                row[int(h[:4], 16) % dimensions] += 1 if h[4] < "8" else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if normalize else out

    return embed


class ModelMismatch(ValueError):
    """A loaded model does not give what it should."""


# The labels of the verifier's two outputs, in order.
HEAD = {0: "entailment", 1: "contradiction"}
# End of fixed values.


def label_rows(names: dict[int, str], required: set[str]) -> dict[str, int]:
    """Which output of a pretrained model stands for each required label, by the model's own names; raises if one is missing."""
    known = {str(v).lower(): int(k) for k, v in names.items()}
    missing = sorted(required - known.keys())
    if missing:
        raise ModelMismatch(f"no output for {', '.join(missing)} among {', '.join(sorted(known))}")
    return {label: known[label] for label in required}


def check_head(names: dict[int, str]) -> None:
    """Raises unless a model has the verifier's two outputs in their order."""
    if {int(k): str(v).lower() for k, v in names.items()} != HEAD:
        raise ModelMismatch(f"outputs {names} instead of {HEAD}")


def verified(make: Callable[[], Embedder], dimensions: int, probes: tuple[str, ...] = ("a probe", "")) -> Callable[[], Embedder]:
    """A factory that loads the model once in a worker and checks, before its first use, the shape, type and finiteness of what it gives for the probes."""

    def load() -> Embedder:
        model = make()
        got = np.asarray(model(list(probes)))
        if got.shape != (len(probes), dimensions):
            raise ModelMismatch(f"shape {got.shape} instead of {(len(probes), dimensions)}")
        if not np.issubdtype(got.dtype, np.floating) or not np.isfinite(got).all():
            raise ModelMismatch(f"values of type {got.dtype} that are no finite numbers")
        if not np.array_equal(got, np.asarray(model(list(probes)))):
            raise ModelMismatch("two calls differ")
        return model

    return load


def overlap_scorer(premises: list[str], hypotheses: list[str]) -> np.ndarray:
    """Logits (entailment, contradiction) from the share of hypothesis words in the premise."""
    out = np.zeros((len(premises), 2))
    for k, (p, h) in enumerate(zip(premises, hypotheses)):
        words = set((h or "").lower().split())
        share = len(words & set((p or "").lower().split())) / len(words) if words else 0.0
        out[k] = (4 * share - 2, 2 - 4 * share)
    return out


def embedding_column(text: Column, make: Callable[[], Embedder] = hashed_embedder) -> Column:
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())), index=texts.index)

    return embed(text)


def softmax_pair(logits: np.ndarray) -> pd.DataFrame:
    """Max-shifted softmax; a tie counts as entailment."""
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return pd.DataFrame({"entailment_probability": p[:, 0], "contradiction_probability": p[:, 1], "verifier_label": np.where(p[:, 0] >= p[:, 1], "entailment", "contradiction")})


def pair_column(premise: Column, hypothesis: Column, scorer: PairScorer = overlap_scorer) -> Column:
    @F.pandas_udf(PAIR)
    def score(premises: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
        return softmax_pair(scorer(premises.tolist(), hypotheses.tolist()))

    return score(premise, hypothesis)


def relevance_column(query: Column, text: Column, scorer: PairScorer = overlap_scorer) -> Column:
    """One score in (0, 1) for each pair: the activation of the scorer's first logit."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-scorer(texts.tolist(), queries.tolist())[:, 0])), index=queries.index)

    return score(query, text)


def embed_with_failures(df: DataFrame, key: str, text: str, make: Callable[[], Embedder] = hashed_embedder) -> DataFrame:
    """(key, vector, error): batches that fail are tried item by item, and what still fails or is not finite is recorded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = pdf[text].tolist()
            try:
                vectors, errors = list(model(texts)), [None] * len(texts)
            except Exception:
                vectors, errors = [], []
                for t in texts:
                    try:
                        vectors.append(model([t])[0])
                        errors.append(None)
                    except Exception as e:
                        vectors.append(None)
                        errors.append(type(e).__name__)
            errors = [e if e or np.isfinite(v).all() else "NotFinite" for v, e in zip(vectors, errors)]
            yield pd.DataFrame({key: pdf[key], "vector": [None if e else v for v, e in zip(vectors, errors)], "error": errors})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>, error string")


Generator = Callable[[str], str]
GENERATION = "generated_text string, prompt_tokens int, generated_tokens int, latency_seconds double, error string"


def chat_prompt(question: str, instruction: str | None = None, turn: str = "{role}: {text}\n") -> str:
    """One text of an optional instruction and a question, in the given form of a turn."""
    turns = [("system", instruction), ("user", question)]
    return "".join(turn.format(role=r, text=t) for r, t in turns if t) + turn.format(role="assistant", text="").rstrip()


def chat_prompt_column(question: Column, instruction: Column) -> Column:
    """The same as ``chat_prompt`` in its default form, as an expression; missing turns are left out."""
    turn = lambda role, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{role}: "), c, F.lit("\n"))).otherwise("")
    return F.concat(turn("system", instruction), turn("user", question), F.lit("assistant:"))


def first_words(n: int = 12) -> Generator:
    """Stand-in for a generator: the first words of the last user turn."""

    def answer(prompt: str) -> str:
        said = prompt.rpartition("user: ")[2].rpartition("\nassistant:")[0]
        return " ".join(said.split()[:n])

    return answer


def shared_word_scores(question: str, choice: str) -> list[float]:
    """Stand-in for a model's token log-probabilities: the log-softmax of 1 against -1 for words of the question, of -1 against 1 for others."""
    known = set((question or "").lower().split())
    rest = math.log(math.exp(1.0) + math.exp(-1.0))
    return [(1.0 if w in known else -1.0) - rest for w in (choice or "").lower().split()]


def generate(df: DataFrame, key: str, prompt: str, make: Callable[[], Generator]) -> DataFrame:
    """(key, generated_text, counts, latency, error): one text for each prompt; a failure becomes a row, never a lost one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = make()
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt]):
                began, text, error = time.perf_counter(), None, None
                try:
                    text = model(p)
                except Exception as e:
                    error = type(e).__name__
                rows.append((k, text, len((p or "").split()), len((text or "").split()), time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=[key, "generated_text", "prompt_tokens", "generated_tokens", "latency_seconds", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, {GENERATION}")


def choice_likelihood(question: Column, choice: Column, token_scores: Callable[[str, str], list[float]]) -> Column:
    """struct(total, per_token) of the log-likelihood of a choice after a question."""

    @F.pandas_udf("total double, per_token double")
    def score(questions: pd.Series, choices: pd.Series) -> pd.DataFrame:
        found = [token_scores(q, c) for q, c in zip(questions, choices)]
        return pd.DataFrame({"total": [float(sum(x)) for x in found], "per_token": [float(sum(x)) / len(x) if x else None for x in found]})

    return score(question, choice)
