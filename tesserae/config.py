"""Settings of builds and queries, with the checks that flags need."""

from __future__ import annotations

import os
import socket
import sys
import time
from collections.abc import Mapping
from dataclasses import dataclass

from tesserae.sources.shared import SharedFiles


@dataclass(frozen=True)
class BuildConfig:
    """One build. role: 'single', 'producer' (embeds its shard) or 'consumer' (merges all shards)."""

    role: str = "single"
    shard_id: int = 0
    num_shards: int = 1
    rebuild: bool = False
    update: bool = False
    writer: bool = True
    on_duplicate: str = "first"
    index: str = "ivfpq"
    target_chars: int = 1200
    short_chars: int = 300
    overlap_chars: int = 200

    def validate(self) -> BuildConfig:
        if self.role not in ("single", "producer", "consumer"):
            raise ValueError(f"no such role: {self.role}")
        if self.rebuild and self.update:
            raise ValueError("a build either starts anew or updates")
        if not 0 <= self.shard_id < max(1, self.num_shards):
            raise ValueError("shard_id must be below num_shards")
        if self.role == "producer" and self.num_shards < 2:
            raise ValueError("producers need two shards or more")
        if self.role == "consumer" and not self.writer:
            raise ValueError("the consumer must be the writer")
        if self.on_duplicate not in ("first", "append"):
            raise ValueError(f"no such choice: {self.on_duplicate}")
        if self.index not in ("flat", "ivf", "ivfpq"):
            raise ValueError(f"no such index: {self.index}")
        if not 0 <= self.overlap_chars < self.target_chars:
            raise ValueError("the overlap must be shorter than a passage")
        return self


@dataclass(frozen=True)
class QueryConfig:
    """One batch of questions. top_papers None takes the number that fits the corpus."""

    top_papers: int | None = None
    top_chunks: int = 24
    per_paper_cap: int = 3
    overshoot: int = 20
    min_chunks_per_paper: float = 2.0
    allow_global_lexical: bool = False
    widen: str = "candidates"

    def validate(self) -> QueryConfig:
        if self.top_chunks < 1 or self.overshoot < 1 or self.per_paper_cap < 0:
            raise ValueError("counts must be positive")
        if self.widen not in ("candidates", "global"):
            raise ValueError(f"no such scope: {self.widen}")
        return self


def question_text(flag_file: str | None, argument: str | None) -> str:
    """The question: of a file, of standard input for '-' in either place, of a file named with '@', or the argument itself.

    An argument with '@' that names no file is the question.
    """
    if "-" in (flag_file, None if flag_file else argument):
        text = sys.stdin.read()
    else:
        named = argument[1:] if argument and argument.startswith("@") and os.path.isfile(argument[1:]) else None
        text = argument or ""
        if flag_file or named:
            with open(flag_file or named, encoding="utf-8") as f:
                text = f.read()
    if not text.strip():
        raise ValueError("there is no question")
    return text.strip()


class WriterGuard:
    """One writer of a store at a time: a file of the store's file system that only one process can create.

    It holds process, host and time, and is never taken from another host; from this one if its process is gone.
    """

    def __init__(self, path: str, shared: SharedFiles):
        self.path, self.shared = path, shared

    def __enter__(self) -> WriterGuard:
        for _ in range(2):
            if self.shared.create_new(self.path, f"{os.getpid()} {socket.gethostname()} {int(time.time())}"):
                return self
            pid, host, _ = [*(self.shared.text(self.path) or "").split(), "", "", ""][:3]
            if host != socket.gethostname() or not pid.isdigit() or os.path.exists(f"/proc/{pid}"):
                break
            self.shared.delete(self.path)  # its process is gone
        raise RuntimeError(f"{host} {pid} is writing")

    def __exit__(self, *_) -> None:
        self.shared.delete(self.path)


@dataclass(frozen=True)
class Paths:
    """Where things are: the store, the archives, and the vocabulary of a model, each given, else named by the
    environment (TESSERAE_STORE, TESSERAE_ARCHIVES, TESSERAE_MODELS), else under home (TESSERAE_HOME, else the working directory)."""

    home: str = ""
    store: str = ""
    archives: str = ""
    models: str = ""

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None, **given: str | None) -> Paths:
        env = os.environ if env is None else env
        home = given.get("home") or env.get("TESSERAE_HOME") or os.getcwd()
        pick = lambda name: given.get(name) or env.get(f"TESSERAE_{name.upper()}") or f"{home.rstrip('/')}/{name}"
        return cls(home, pick("store"), pick("archives"), pick("models"))


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"
