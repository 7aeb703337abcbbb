"""Models behind interfaces, with deterministic offline stand-ins.

A provider is created once per worker and called with batches. The stand-ins need
no weights: they make pipelines testable, not answers good. Language models are
called through ``call_column``, which adds what a call used and how it went to the
row; the ledger is a selection of those columns.
"""

from __future__ import annotations

import base64
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StructField, StructType

WORD = re.compile(r"\w+")


class Encoder(Protocol):
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, passages: Sequence[str]) -> list[float] | None: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class EncoderFailure(RuntimeError):
    """An encoder or reranker that must not be used: raised before or after a run, never in a row."""


class JudgeUnavailable(RuntimeError):
    """A verdict that could not be had; rows carry it as NULL."""


class ClientError(RuntimeError):
    """A request the server refused: asking again does not help."""


@dataclass
class Completion:
    """What a call gave and what it used."""

    text: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    latency_s: float = 0.0
    ok: bool = True
    truncated: bool = False  # the prompt did not fit
    output_capped: bool = False  # the answer hit its limit
    transport_failed: bool = False
    images_sent: int = 0
    logprobs: list | None = None  # of (logprob, runner-up's logprob or None)


CALL = (
    "struct<text:string,prompt_tokens:int,completion_tokens:int,latency_s:double,ok:boolean,truncated:boolean,output_capped:boolean,"
    "transport_failed:boolean,images_sent:int,logprobs:array<struct<logprob:double,second:double>>>"
)


@dataclass
class HashEncoder:
    """Signed hashed word counts at unit length; texts without a word are zero."""

    dim: int = 96

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for w, n in Counter(WORD.findall((text or "").lower())).items():
                h = crc32(w.encode())
                out[i, h % self.dim] += n if h & (1 << 20) else -n
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


@dataclass
class OverlapReranker:
    """Share of the query's words in the passage, damped by its length."""

    def score(self, query: str, passages: Sequence[str]) -> list[float] | None:
        want = set(WORD.findall(query.lower()))
        found = [Counter(WORD.findall((p or "").lower())) for p in passages]
        return [len(want & set(c)) / max(len(want), 1) - 0.001 * sum(c.values()) ** 0.5 for c in found]


@dataclass
class ExtractiveReader:
    """Answers with the pack's sentence that shares most words with the question.

    A prompt is a question line and the pack, or has PASSAGES and a QUESTION.
    """

    def complete(self, prompt: str) -> str:
        question, _, pack = prompt.partition("\n")
        if "\nQUESTION: " in prompt:
            pack, _, rest = prompt.partition("\nQUESTION: ")
            question, pack = rest.partition("\n")[0], pack.partition("PASSAGES:\n")[2]
        want = set(WORD.findall(question.lower()))
        best = max(re.split(r"(?<=[.!?])\s+|\n", pack), key=lambda s: (len(want & set(WORD.findall(s.lower()))), -len(s)), default="")
        return best.strip() or "NOT_FOUND"


def encode_column(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = 64) -> DataFrame:
    """``df`` with the encoder's vectors; failures and NULL texts give NULL."""
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), batch):
                part = frame[text].iloc[at : at + batch].tolist()
                for t, v in zip(part, encoder.encode([t or "" for t in part])):
                    vectors.append(v.tolist() if t and np.isfinite(v).all() and v.any() else None)
            yield frame.assign(**{out: pd.Series(vectors, index=frame.index, dtype=object)})

    return df.mapInPandas(run, schema)


def check_encoder(encoder: Encoder) -> None:
    """Fail before the job starts, not in it."""
    probe = encoder.encode(["a probe"])
    if probe.shape != (1, encoder.dim) or not np.isfinite(probe).all():
        raise EncoderFailure("the encoder's output does not have its stated size")


def check_reranker(reranker: Reranker) -> None:
    scores = reranker.score("where is the key", ["the key is here", "rain falls"])
    if not scores or not scores[0] > scores[1]:
        raise EncoderFailure("the reranker orders a plain pair wrongly")


def final_check(failures: int, texts: int, most: float = 0.0) -> None:
    """After a run: fail if more than a share of the texts got no vector."""
    if texts and failures / texts > most:
        raise EncoderFailure(f"{failures} of {texts} texts were not encoded")


class SafeReranker:
    """A reranker that, once it failed or gave something that is no number, stays failed for its worker."""

    def __init__(self, inner: Reranker) -> None:
        self.inner, self.failed = inner, False

    def score(self, query: str, passages: Sequence[str]) -> list[float] | None:
        if self.failed:
            return None
        try:
            scores = [float(s) for s in self.inner.score(query, passages) or []]
            if len(scores) == len(passages) and np.isfinite(scores).all():
                return scores
        except Exception:  # noqa: BLE001 - whatever the model raised
            pass
        self.failed = True
        return None


# Language models --------------------------------------------------------------


def approximate_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def fits(prompt: str, window: int, reserve: int = 0) -> bool:
    """Whether a prompt probably fits a context window (3.6 characters a token), with ``reserve`` tokens for the answer."""
    return len(prompt) / 3.6 + reserve <= window


class Backend:
    """A model behind a request: retries, and an empty answer where it fails for good.

    Subclasses give ``request``. A refused request (``ClientError``) is not repeated;
    others are, after each of ``waits`` seconds.
    """

    #: Seconds before the second, third, fourth and fifth attempt.
    waits: Sequence[float] = (5, 15, 45, 90)
    window: int = 8192

    def request(self, prompt: str, images: Sequence[str], max_tokens: int, temperature: float, logprobs: bool) -> Completion:
        raise NotImplementedError

    def call(self, prompt: str, images: Sequence[str] = (), max_tokens: int = 256, temperature: float = 0.0, logprobs: bool = False, sleep: Callable[[float], None] = time.sleep) -> Completion:
        began, failed = time.monotonic(), False
        for wait in (*self.waits, None):
            try:
                done = self.request(prompt, images, max_tokens, temperature, logprobs)
                done.latency_s = time.monotonic() - began
                done.truncated |= not fits(prompt, self.window, max_tokens)
                done.prompt_tokens = done.prompt_tokens or approximate_tokens(prompt)
                done.completion_tokens = done.completion_tokens or approximate_tokens(done.text)
                return done
            except ClientError:
                break
            except Exception:  # noqa: BLE001 - any failure of transport or server
                failed = True
                if wait is not None:
                    sleep(wait)
        return Completion(prompt_tokens=approximate_tokens(prompt), latency_s=time.monotonic() - began, ok=False, transport_failed=failed)

    def complete(self, prompt: str) -> str:
        return self.call(prompt).text


@dataclass
class Scripted(Backend):
    """Answers by a function of the prompt: for tests and offline runs."""

    reply: Callable[[str], str]
    waits: Sequence[float] = ()

    def request(self, prompt, images, max_tokens, temperature, logprobs):
        return Completion(text=self.reply(prompt), images_sent=len(images))


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    data = json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}), timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if 400 <= e.code < 500:
            raise ClientError(f"{e.code} from {url}") from e
        raise


def _encoded(images: Sequence[str]) -> list[str]:
    return [base64.b64encode(Path(p).read_bytes()).decode() for p in images if p and os.path.exists(p)]


@dataclass
class LocalServer(Backend):
    """A model served locally under ``/api/generate``."""

    model: str
    url: str = "http://127.0.0.1:11434"
    window: int = 8192
    timeout: float = 600.0

    def request(self, prompt, images, max_tokens, temperature, logprobs):
        sent = _encoded(images)
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens, "num_ctx": self.window}}
        body |= {"images": sent} if sent else {}
        body |= {"logprobs": True, "top_logprobs": 2} if logprobs else {}
        body |= {"think": False} if is_thinking(self.model) else {}
        a = _post(f"{self.url}/api/generate", body, {}, self.timeout)
        return Completion(
            a.get("response") or "", a.get("prompt_eval_count") or 0, a.get("eval_count") or 0, output_capped=a.get("done_reason") == "length", images_sent=len(sent), logprobs=_pairs(a.get("logprobs"))
        )


@dataclass
class ChatServer(Backend):
    """A model behind the chat-completions interface."""

    model: str
    url: str = "https://api.openai.com/v1"
    key: str = ""
    window: int = 128_000
    timeout: float = 600.0
    waits: Sequence[float] = (1, 2, 4, 8, 16, 32, 64, 64)

    def request(self, prompt, images, max_tokens, temperature, logprobs):
        sent = _encoded(images)
        content = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{x}"}} for x in sent)] if sent else prompt
        body = {"model": self.model, "messages": [{"role": "user", "content": content}], "temperature": temperature, "max_tokens": max_tokens}
        body |= {"logprobs": True, "top_logprobs": 2} if logprobs else {}
        a = _post(f"{self.url}/chat/completions", body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        first, usage = a["choices"][0], a.get("usage") or {}
        return Completion(
            first["message"].get("content") or "", usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0,
            output_capped=first.get("finish_reason") == "length", images_sent=len(sent), logprobs=_pairs((first.get("logprobs") or {}).get("content")),
        )


def _pairs(tokens: list[dict] | None) -> list[tuple[float, float | None]] | None:
    """(log-probability, that of the runner-up) of each token that has one."""
    if not tokens:
        return None
    tops = [(t.get("logprob"), [x.get("logprob") for x in t.get("top_logprobs") or []]) for t in tokens]
    return [(lp, top[1] if len(top) > 1 else None) for lp, top in tops if lp is not None]


#: Context windows by the beginning of a model's name; the longest match counts.
WINDOWS = {"gpt-4.1": 1_000_000, "gpt-4o": 128_000, "gpt-4": 8_192, "gpt-3.5": 16_385, "qwen": 32_768, "gemma": 32_768, "llama": 32_768}


def window_of(model: str, default: int = 8192) -> int:
    best = max((p for p in WINDOWS if model.lower().startswith(p)), key=len, default=None)
    return WINDOWS[best] if best else default


def is_thinking(model: str) -> bool:
    """Whether a model thinks aloud unless told not to."""
    return bool(re.match(r"(?i)(?:.*/)?(?:qwen3|deepseek-r1|qwq)", model))


def make_model(backend: str, model: str, **more) -> Backend:
    """``local`` or ``chat`` server of the named model, with the window of its name."""
    kinds = {"local": LocalServer, "chat": ChatServer}
    if backend not in kinds:
        raise ValueError(f"unknown backend {backend!r}")
    return kinds[backend](model, **({"window": window_of(model)} | more))


def resolve(provider) -> Backend | None:
    """The model in whatever holds one: itself, or its attribute ``llm`` or ``model``."""
    for x in (provider, getattr(provider, "llm", None), getattr(provider, "model", None)):
        if x is not None and not isinstance(x, str) and (hasattr(x, "call") or hasattr(x, "complete")):
            return x
    return None


_KEPT: dict[str, object] = {}


def shared_by_worker(name: str, make: Callable[[], object]):
    """One instance a worker process: models are loaded once, not once a batch."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def called(model, prompt: str, images: Sequence[str] = (), **options) -> Completion:
    """A call of anything that has ``call`` or ``complete``; an exception is a failed call."""
    if hasattr(model, "call"):
        return model.call(prompt, images, **options)
    began = time.monotonic()
    try:
        text = model.complete(prompt)
        return Completion(text or "", approximate_tokens(prompt), approximate_tokens(text or ""), time.monotonic() - began)
    except Exception:  # noqa: BLE001
        return Completion(prompt_tokens=approximate_tokens(prompt), latency_s=time.monotonic() - began, ok=False)


def call_column(df: DataFrame, prompt: str, model, out: str = "call", images: str | None = None, **options) -> DataFrame:
    """``df`` with one call of the model per row as struct column ``out``; a NULL prompt makes no call."""
    schema = StructType([*df.schema.fields, StructField(out, DataType.fromDDL(CALL))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pictures = frame[images] if images else [()] * len(frame)
            rows = []
            for p, i in zip(frame[prompt], pictures):
                row = asdict(called(model, p, [] if i is None else list(i), **options)) if isinstance(p, str) else None
                if row is not None and row["logprobs"] is not None:
                    row["logprobs"] = [{"logprob": a, "second": b} for a, b in row["logprobs"]]
                rows.append(row)
            yield frame.assign(**{out: pd.Series(rows, index=frame.index, dtype=object)})

    return df.mapInPandas(run, schema)


def ledger(calls: DataFrame, role: str, model: str, *scope: str, call: str = "call") -> DataFrame:
    """Call records of a frame with calls: ``scope`` columns (a question, a run), role, model and usage.

    A scope is a filter on its columns, so nothing has to be opened, closed or reset.
    """
    return calls.where(F.col(call).isNotNull()).select(*scope, F.lit(role).alias("role"), F.lit(model).alias("model"), *[F.col(f"{call}.{c}").alias(c) for c in (
        "prompt_tokens", "completion_tokens", "latency_s", "ok", "truncated", "output_capped", "transport_failed")])


def answer_confidence(logprobs: Column) -> Column:
    """Struct of what a call's log-probabilities say: mean, least, sum, tokens, mean and least margin to the runner-up.

    ``logprobs``: array of struct(logprob, second). NULL without a token; margins are
    NULL where no token has a runner-up.
    """
    lps = F.filter(F.transform(logprobs, lambda x: x["logprob"]), lambda x: x.isNotNull())
    gaps = F.filter(F.transform(logprobs, lambda x: x["logprob"] - x["second"]), lambda x: x.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    found = F.struct(
        (total(lps) / F.size(lps)).alias("lp_mean"), F.array_min(lps).alias("lp_min"), total(lps).alias("lp_sum"), F.size(lps).alias("n_tokens"),
        F.when(F.size(gaps) > 0, total(gaps) / F.size(gaps)).alias("lp_margin_mean"), F.array_min(gaps).alias("lp_margin_min"),
    )
    return F.when(F.size(lps) > 0, found)


# Costs ---------------------------------------------------------------------------


@dataclass
class Metered:
    """A provider with a stopwatch: seconds, calls and approximate tokens of its own worker."""

    inner: object
    seconds: float = 0.0
    calls: int = 0
    texts: int = 0
    tokens: int = 0
    methods: Sequence[str] = field(default=("encode", "score", "complete", "call"))

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "inner":
            raise AttributeError(name)
        found = getattr(self.inner, name)
        if name not in self.methods:
            return found

        def timed(*args, **kw):
            began = time.monotonic()
            try:
                return found(*args, **kw)
            finally:
                self.seconds += time.monotonic() - began
                self.calls += 1
                given = args[-1] if args else ""
                given = [given] if isinstance(given, str) else [t for t in given if isinstance(t, str)]
                self.texts += len(given)
                self.tokens += sum(approximate_tokens(t) for t in given)

        return timed


# Images ---------------------------------------------------------------------------


@dataclass
class Captioner:
    """Captions of images, in a few words or in detail; without a model, or where it fails, the file's name says what it can."""

    model: object | None = None
    detailed: bool = False

    def caption(self, path: str | None) -> str:
        if not path:
            return ""
        if self.model is not None:
            ask = "Describe this image in detail." if self.detailed else "Describe this image in one short sentence."
            done = called(self.model, ask, [path], max_tokens=256 if self.detailed else 64)
            if done.ok and done.text.strip():
                return " ".join(done.text.split())
        return re.sub(r"[\W_]+", " ", Path(path).stem).strip()


def caption_column(df: DataFrame, path: str, captioner: Captioner, out: str = "caption") -> DataFrame:
    schema = StructType([*df.schema.fields, StructField(out, DataType.fromDDL("string"))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: [captioner.caption(p) for p in frame[path]]})

    return df.mapInPandas(run, schema)
