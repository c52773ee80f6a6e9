"""Experiment configuration: plain dataclasses whose rules are declared with the fields."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any, TypeVar

T = TypeVar("T")

_RULES = {
    "positive": (lambda v: v > 0, "is not positive"),
    "not_negative": (lambda v: v >= 0, "is negative"),
    "given": (lambda v: bool(v), "is empty"),
}


def _must(rule: str, **how: Any) -> Any:
    return field(metadata={"rule": rule}, **how)


class Checked:
    """Applies each field's rule; an unset (None) value passes."""

    def __post_init__(self) -> None:
        for f in fields(self):  # type: ignore[arg-type]
            value, rule = getattr(self, f.name), f.metadata.get("rule")
            if rule and value is not None and not _RULES[rule][0](value):
                raise ValueError(f"{f.name} {_RULES[rule][1]}")
        self.relations()

    def relations(self) -> None:
        """Rules between fields."""


@dataclass(frozen=True)
class Model(Checked):
    vocab_size: int | None = _must("positive")
    block_size: int = _must("positive")
    n_layer: int = _must("positive")
    n_embd: int = _must("positive")
    n_head: int = _must("positive")
    n_head_kv: int = _must("positive")
    intermediate_size: int = _must("positive")
    rope_theta: float = _must("positive", default=10_000.0)
    rms_norm_eps: float = _must("positive", default=1e-6)
    attention_bias: bool = False
    tie_embeddings: bool = True
    use_sdpa: bool = True

    def relations(self) -> None:
        for whole, part in (("n_embd", "n_head"), ("n_head", "n_head_kv")):
            if getattr(self, whole) % getattr(self, part):
                raise ValueError(f"{whole} is no multiple of {part}")

    def resolved(self, tokenizer: Any) -> Model:
        """With the tokenizer's vocabulary size, which must agree with one that is set."""
        n = tokenizer.vocab_size
        if n <= 0 or self.vocab_size not in (None, n):
            raise ValueError(f"vocab_size {self.vocab_size} does not fit the tokenizer's {n}")
        return replace(self, vocab_size=n)


@dataclass(frozen=True)
class Training(Checked):
    batch_size: int = _must("positive")
    learning_rate: float = _must("positive")
    weight_decay: float = _must("not_negative")
    max_steps: int = _must("positive")
    warmup_steps: int = _must("not_negative")
    min_learning_rate: float = _must("not_negative")
    max_grad_norm: float = _must("positive")
    log_interval: int = _must("positive")
    eval_interval: int = _must("positive")
    checkpoint_interval: int = _must("positive")
    checkpoint_dir: str = ""
    mixed_precision: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Data(Checked):
    root: str = _must("given")
    train_split: str = _must("given")
    validation_split: str = _must("given")
    source_weights: dict[str, float] = _must("given")

    def relations(self) -> None:
        if min(self.source_weights.values()) <= 0 or abs(sum(self.source_weights.values()) - 1) > 1e-6:
            raise ValueError("source_weights must be positive and sum to 1")


@dataclass(frozen=True)
class TokenizerName(Checked):
    name: str = _must("given")
    revision: str = "main"
    local_files_only: bool = False


@dataclass(frozen=True)
class TuningData(Checked):
    train_dir: str = _must("given")
    validation_dir: str = _must("given")

    def relations(self) -> None:
        if self.train_dir == self.validation_dir:
            raise ValueError("train_dir and validation_dir must differ")


@dataclass(frozen=True)
class Tuning(Checked):
    checkpoint: str
    output_dir: str
    batch_size: int = _must("positive")
    learning_rate: float = _must("positive")
    weight_decay: float = _must("not_negative")
    num_epochs: int = _must("positive")
    warmup_steps: int = _must("not_negative")
    max_grad_norm: float = _must("positive")
    log_interval: int = _must("positive")
    eval_interval: int = _must("positive")
    checkpoint_interval: int = _must("positive")
    mixed_precision: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Experiment:
    model: Model
    training: Training
    tokenizer: TokenizerName
    data: Data


@dataclass(frozen=True)
class TuningExperiment:
    model: Model
    training: Tuning
    tokenizer: TokenizerName
    data: TuningData


_PARTS = {Experiment: (Model, Training, TokenizerName, Data), TuningExperiment: (Model, Tuning, TokenizerName, TuningData)}


def load(path: str, kind: type[T] = Experiment) -> T:  # type: ignore[assignment]
    """Read a YAML file of the sections model, training, tokenizer and data."""
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f)
    return kind(*(part(**values[name.name]) for name, part in zip(fields(kind), _PARTS[kind])))  # type: ignore[arg-type]
