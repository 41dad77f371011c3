"""Language models as loss providers: what a response costs after its context and alone. They load on first use, on the executors, and only if installed.

The context goes through the model's own chat template (without context: its begin token, or else its end token); the response is tokenised by itself, and
what is longer than the model's context is an error, never cut.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.metadata
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from quern.operators.score import Provider, fixed_provider, function_provider

#: Files of a local model folder that its losses follow from.
WEIGHTS = (".json", ".safetensors", ".bin", ".gguf", ".model", ".txt")


@dataclass(frozen=True)
class Identity:
    """What losses follow from; the key of cached ones."""

    provider: str
    model: str
    revision: str | None
    runtime: str | None
    chat_template_sha256: str | None
    max_tokens: int


@dataclass(frozen=True)
class Model:
    """A provider that knows its identity."""

    identity: Identity
    provide: Provider

    def __call__(self, asked: DataFrame) -> DataFrame:
        return self.provide(asked)

    def told(self) -> dict:
        return asdict(self.identity)


def fingerprint(path: str | Path) -> str:
    """SHA-256 of a model file, or of names and digests of the files of a model folder; it changes with any of them."""
    place = Path(path)
    files = [place] if place.is_file() else sorted(p for p in place.iterdir() if p.is_file() and p.suffix in WEIGHTS)
    lines = []
    for p in files:
        with open(p, "rb") as f:
            lines.append(f"{p.name} {hashlib.file_digest(f, 'sha256').hexdigest()}\n")
    return "sha256:" + hashlib.sha256("".join(lines).encode()).hexdigest()


def _runtime(package: str) -> str:
    try:
        return f"{package} {importlib.metadata.version(package)}"
    except importlib.metadata.PackageNotFoundError as missing:
        raise ValueError(f"{package} is not installed") from missing


def mean_loss(rows: np.ndarray, tokens: list[int]) -> float:
    """Mean negative log-probability of tokens under rows of logits, one row for each."""
    top = rows.max(axis=1, keepdims=True)
    log_sum = (top + np.log(np.exp(rows - top).sum(axis=1, keepdims=True)))[:, 0]
    loss = float(np.mean(log_sum - rows[np.arange(len(tokens)), tokens]))
    if not math.isfinite(loss):
        raise ValueError("the model gives a loss that is not finite")
    return loss


def spans(head: list[int], tail: list[int], max_tokens: int) -> tuple[list[int], list[int]]:
    """Context and response tokens, if both have some and fit."""
    if not head or not tail:
        raise ValueError("context and response need a token at least")
    if len(head) + len(tail) > max_tokens:
        raise ValueError(f"{len(head) + len(tail)} tokens are more than the {max_tokens} of the context")
    return head, tail


def fixed(conditional: float = 1.0, unconditional: float = 2.0) -> Model:
    """Constant losses, for tests."""
    return Model(Identity("fixed", f"{conditional}/{unconditional}", None, None, None, 0), fixed_provider(conditional, unconditional))


def transformers(model: str, revision: str | None = None, max_tokens: int = 2048) -> Model:
    """A causal language model of the transformers library, on CPU: a local folder, whose files are its revision, or a name with a revision."""
    if max_tokens < 2:
        raise ValueError("max_tokens must be 2 or more")
    if not model:
        raise ValueError("a transformers model needs a name or folder")
    runtime = _runtime("transformers")
    if Path(model).is_dir():
        revision = fingerprint(model)

    def load() -> Callable[[list[dict], str], float]:
        torch, library = importlib.import_module("torch"), importlib.import_module("transformers")
        named = None if revision and revision.startswith("sha256:") else revision
        coder = library.AutoTokenizer.from_pretrained(model, revision=named)
        network = library.AutoModelForCausalLM.from_pretrained(model, revision=named).to("cpu").eval()
        begin = [t for t in (coder.bos_token_id, coder.eos_token_id) if t is not None][:1]

        def loss(prefix: list[dict], target: str) -> float:
            if prefix and not coder.chat_template:
                raise ValueError("the model has no chat template")
            asked = coder.encode(coder.apply_chat_template(prefix, tokenize=False, add_generation_prompt=True), add_special_tokens=False) if prefix else begin
            head, tail = spans(asked, coder.encode(target, add_special_tokens=False), max_tokens)
            with torch.inference_mode():
                logits = network(torch.tensor([head + tail])).logits[0, len(head) - 1 : -1]
            return mean_loss(logits.double().numpy(), tail)

        return loss

    return Model(Identity("transformers", model, revision, runtime, None, max_tokens), function_provider(load))


def llama(path: str, max_tokens: int = 2048, threads: int = 4, name: str | None = None, provider: str = "llama") -> Model:
    """A local GGUF model by llama-cpp-python, with the chat template in its metadata; the digest of the file is its revision."""
    if max_tokens < 2 or threads < 1:
        raise ValueError("max_tokens must be 2 or more, and threads positive")
    if not Path(path).is_file():
        raise ValueError(f"no model file {path}")
    runtime = _runtime("llama-cpp-python")

    def load() -> Callable[[list[dict], str], float]:
        library, sandbox = importlib.import_module("llama_cpp"), importlib.import_module("jinja2.sandbox")
        network = library.Llama(model_path=str(path), n_ctx=max_tokens, n_threads=threads, n_gpu_layers=0, logits_all=True, verbose=False, seed=42)
        told = network.metadata.get("tokenizer.chat_template")
        if not told:
            raise ValueError("the model has no chat template")
        template = sandbox.ImmutableSandboxedEnvironment().from_string(told)
        begin = [t for t in (network.token_bos(), network.token_eos()) if t >= 0][:1]

        def loss(prefix: list[dict], target: str) -> float:
            asked = network.tokenize(template.render(messages=prefix, add_generation_prompt=True).encode(), add_bos=False, special=True) if prefix else begin
            head, tail = spans(list(asked), list(network.tokenize(target.encode(), add_bos=False, special=False)), max_tokens)
            network.reset()
            network.eval(head + tail)
            return mean_loss(np.asarray(network.scores[len(head) - 1 : len(head) + len(tail) - 1], np.float64), tail)

        return loss

    return Model(Identity(provider, name or Path(path).name, fingerprint(path), runtime, None, max_tokens), function_provider(load))


#: The package and file of the small model that comes as a Python package.
BUNDLED = ("llm-smollm2", "llm_smollm2/SmolLM2-135M-Instruct.Q4_1.gguf")


def bundled(max_tokens: int = 2048, threads: int = 4) -> Model:
    """The small model of a Python package, offline; an error if that isn't installed."""
    try:
        place = importlib.metadata.distribution(BUNDLED[0]).locate_file(BUNDLED[1])
    except importlib.metadata.PackageNotFoundError as missing:
        raise ValueError(f"the bundled model needs the package {BUNDLED[0]}; name another provider") from missing
    return llama(str(place), max_tokens, threads, BUNDLED[1].rpartition("/")[2], "bundled")
