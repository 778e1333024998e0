"""Answers from packed passages by a model behind an interface; without one the context itself is the answer."""

from __future__ import annotations

import importlib.util
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.functions.errors import ADVICE, message_class
from tesserae.functions.text import hashed_words

PROMPT = "Answer from the numbered passages alone and cite the passages you use, like [1] or [2, 3]. If they do not hold the answer, say so."


class Overflow(Exception):
    """The prompt was too long for the model."""


class ModelError(Exception):
    """Any other failure; the message says what to do."""


@dataclass(frozen=True)
class ModelConfig:
    """budget: tokens of prompt and answer; by name, 32,000 for the o3 family and 8,000 for others unless given."""

    model: str = "local"
    budget: int | None = None
    max_out: int = 3000
    headroom: int = 200
    prompt: str = PROMPT

    @property
    def tokens(self) -> int:
        return self.budget if self.budget is not None else (32_000 if self.model.startswith("o3") else 8_000)


class Embedder(Protocol):
    """Vectors of a text column, width long; empty input gives no rows."""

    width: int

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class WordEmbedder:
    """Hashed word counts: deterministic, without a model."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, hashed_words(text, self.width).cast("array<float>"))


class ModelEmbedder:
    """Vectors of a sentence model by name, where its library is installed; loaded once for each worker process.

    words: as many word pieces of a text count. pool: 'cls' takes the first position, 'mean' all.
    """

    def __init__(self, model: str, width: int, pool: str = "mean", words: int = 512, batch: int = 16):
        if importlib.util.find_spec("transformers") is None or importlib.util.find_spec("torch") is None:
            raise NotImplementedError("models need the libraries torch and transformers; WordEmbedder needs none")
        self.model, self.width, self.pool, self.words, self.batch = model, width, pool, words, batch

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        how = (self.model, self.pool, self.words, self.batch)
        keep = [c for c in df.columns if c != out]

        def run(batches):
            import pyarrow as pa

            for rb in batches:
                vectors = _encoded(rb.column(rb.schema.get_field_index(text)).to_pylist(), *how)
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, out])

        src = df.select(*keep)
        return src.mapInArrow(run, df.select(*keep).schema.add(out, T.ArrayType(T.FloatType())))


_MODELS: dict = {}


def _encoded(texts: list[str], model: str, pool: str, words: int, batch: int) -> list:
    import torch
    from transformers import AutoModel, AutoTokenizer

    if model not in _MODELS:
        _MODELS[model] = (AutoTokenizer.from_pretrained(model), AutoModel.from_pretrained(model).eval())
    tokenizer, net = _MODELS[model]
    out = []
    for i in range(0, len(texts), batch):
        enc = tokenizer([t or "" for t in texts[i : i + batch]], padding=True, truncation=True, max_length=words, return_tensors="pt")
        with torch.no_grad():
            hidden = net(**enc).last_hidden_state
        mask = enc["attention_mask"].unsqueeze(-1)
        v = hidden[:, 0] if pool == "cls" else (hidden * mask).sum(1) / mask.sum(1)
        out += torch.nn.functional.normalize(v, dim=1).tolist()
    return out


#: Known models: width, pooling and word pieces (fixed values).
MODELS = {"allenai/specter2_base": (768, "cls", 512), "sentence-transformers/all-mpnet-base-v2": (768, "mean", 384)}


def embedder_for(name: str = "words") -> Embedder:
    """'words', or the name of a model."""
    if name == "words":
        return WordEmbedder()
    width, pool, words = MODELS.get(name, (768, "mean", 512))
    return ModelEmbedder(name, width, pool, words)


class Provider(Protocol):
    def generate(self, prompt: str, system: str, max_out: int) -> str: ...


class ContextOnly:
    """Stands in where there is no model: the answer is the context."""

    def generate(self, prompt: str, system: str, max_out: int) -> str:
        return prompt.partition("CONTEXT:\n")[2]


#: Where the public service of that interface answers; other addresses are servers of one's own (fixed value).
PUBLIC_HOST = "api.openai.com"


def is_public_cloud(url: str) -> bool:
    """Whether an endpoint is the public service, which needs a key."""
    return (urllib.parse.urlparse(url if "//" in url else f"//{url}").hostname or "") == PUBLIC_HOST


@dataclass(frozen=True)
class HttpProvider:
    """A model behind an HTTP endpoint that takes chat completions (how 'chat') or responses ('responses')."""

    url: str
    model: str
    key: str = ""
    how: str = "chat"
    timeout: float = 120

    def generate(self, prompt: str, system: str, max_out: int) -> str:
        if is_public_cloud(self.url) and not self.key:
            raise ModelError(ADVICE["auth"])
        if self.how == "chat":
            path, body = "chat/completions", {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "max_tokens": max_out}
        else:
            path, body = "responses", {"model": self.model, "instructions": system, "input": prompt, "max_output_tokens": max_out}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        ask = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                got = json.load(r)
        except urllib.error.HTTPError as e:
            raise ModelError(f"{e.code} {e.reason}: {e.read(2000).decode(errors='replace')}") from e
        except (OSError, ValueError) as e:
            raise ModelError(str(e)) from e
        return said(got)


def said(got: dict) -> str:
    """The text of an answer of either form."""
    if "choices" in got:
        return got["choices"][0]["message"]["content"] or ""
    if "output_text" in got:
        return got["output_text"]
    return "".join(c.get("text", "") for item in got.get("output", []) for c in item.get("content", []))


def provider_for(url: str, model: str, key: str = "", how: str = "auto") -> Provider:
    """A provider for an endpoint: 'chat', 'responses', or 'auto', where o3 models are asked by responses first and others by
    chat first, the other way if the endpoint does not offer it; without an address the context itself is the answer."""
    if not url:
        return ContextOnly()
    if how != "auto":
        return HttpProvider(url, model, key, how)
    order = ("responses", "chat") if model.startswith("o3") else ("chat", "responses")
    return FirstThatWorks([HttpProvider(url, model, key, h) for h in order])


@dataclass
class FirstThatWorks:
    """Asks providers in turn; one that does not offer the call hands over to the next."""

    providers: list[Provider] = field(default_factory=list)

    def generate(self, prompt: str, system: str, max_out: int) -> str:
        last: Exception | None = None
        for p in self.providers:
            try:
                return p.generate(prompt, system, max_out)
            except Overflow:
                raise
            except Exception as e:
                if message_class(str(e)) != "unsupported":
                    raise
                last = e
        raise last or ModelError("no provider")


@dataclass(frozen=True)
class Attempt:
    """What one call sends: blocks of passages, and the most tokens of the answer."""

    blocks: list[str]
    max_out: int


def answer(question: str, attempts: list[Attempt], provider: Provider, config: ModelConfig = ModelConfig()) -> tuple[str, int]:
    """(answer, passages sent) of the first attempt that the model has room for; ranking.attempts plans them."""
    for a in attempts:
        context = "\n\n".join(a.blocks) or "(no context)"
        try:
            return provider.generate(f"QUESTION:\n{question}\n\nCONTEXT:\n{context}", config.prompt, a.max_out), len(a.blocks)
        except Overflow:
            continue
        except Exception as e:
            kind = message_class(str(e))
            if kind != "overflow":
                raise ModelError(f"{ADVICE[kind]} ({e})") from e
    raise Overflow(ADVICE["overflow"])


REWRITERS: dict[str, Callable[[str], str]] = {"none": lambda q: q}


def rewrite(question: str, how: str = "none") -> str:
    """The question as the named rewriter puts it; only 'none' is there unless others are registered."""
    if how not in REWRITERS:
        raise NotImplementedError(how)
    return REWRITERS[how](question)
