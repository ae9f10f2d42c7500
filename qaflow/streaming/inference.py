"""The model boundary: a provider turns batches of prompts into texts inside ``mapInPandas``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Makes a function from a list of prompts to a list of texts; called once in each worker.
Provider = Callable[[], Callable[[list[str]], list[str]]]


@dataclass(frozen=True)
class SamplingParams:
    temperature: float
    top_p: float
    top_k: int = 20
    max_tokens: int = 512

    @classmethod
    def for_mode(cls, thinking: bool, **other) -> SamplingParams:
        """The defaults with and without thinking."""
        return cls(0.6, 0.95, **other) if thinking else cls(0.7, 0.8, **other)


def sampling_columns(thinking: Column, **given: Column) -> Column:
    """struct<temperature, top_p, top_k, max_tokens> of each request: what it gives, else the defaults of its mode (null: without thinking)."""
    on, off = (SamplingParams.for_mode(mode) for mode in (True, False))
    default = {f.name: F.when(thinking, getattr(on, f.name)).otherwise(getattr(off, f.name)) for f in fields(SamplingParams)}
    chosen = [(F.coalesce(given[name], c) if name in given else c).alias(name) for name, c in default.items()]
    return F.struct(*chosen)


def stub_provider() -> Callable[[list[str]], list[str]]:
    """A deterministic stand-in: thinks the prompt's first words and answers its last word."""

    def generate(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            words = p.split()
            out.append(f"<think>{' '.join(words[:8])}</think><answer>{words[-1] if words else ''}</answer>")
        return out

    return generate


def full_batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of a task in batches of exactly ``size``, carried over the frames in which they come; the last one may be shorter."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        while len(frame):
            part = frame.iloc[: size - n]
            held.append(part)
            n += len(part)
            frame = frame.iloc[len(part) :]
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _answered(generate, batch: pd.DataFrame, prompt: str, kept: list[str], output: str) -> pd.DataFrame:
    texts = generate(batch[prompt].fillna("").tolist())
    if len(texts) != len(batch):
        raise ValueError(f"{len(texts)} texts for {len(batch)} prompts")
    return batch[kept].assign(**{output: texts})


def infer(df: DataFrame, prompt: str, provider: Provider = stub_provider, batch_size: int = 8, output: str = "raw_output") -> DataFrame:
    """``df`` with the provider's text for each prompt; null prompts count as empty. Only a task's last batch has fewer than ``batch_size`` rows."""
    kept = [c for c in df.columns if c != output]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = provider()
        for batch in full_batches(frames, batch_size):
            yield _answered(generate, batch, prompt, kept, output)

    return df.mapInPandas(run, df.select(*kept).schema.add(output, "string"))


def infer_on_slots(
    df: DataFrame, prompt: str, slots: int, provider: Provider = stub_provider, batch_size: int = 8, output: str = "raw_output", gpus: int = 0, probe: str = "ready?",
) -> DataFrame:
    """``infer`` as one stage of ``slots`` tasks that start together, one provider each, on an accelerator each where ``gpus`` > 0.

    Every task loads its provider and answers ``probe`` before any row is sent; the outcomes are exchanged over the barrier, and
    if one has failed all fail at once with every slot's message, so no slot works on while another will never come up. Rows are
    dealt evenly over the slots. The cluster must have ``slots`` free task slots.
    """
    kept = [c for c in df.columns if c != output]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context, generate, said = BarrierTaskContext.get(), None, ""
        try:
            generate = provider()
            if len(generate([probe])) != 1:
                said = "the probe has no answer"
        except Exception as e:  # noqa: BLE001  told to all slots, which then fail
            said = f"{type(e).__name__}: {e}"
        outcomes = context.allGather(said)
        if any(outcomes):
            raise RuntimeError("; ".join(f"slot {i}: {x}" for i, x in enumerate(outcomes) if x))
        for batch in full_batches(frames, batch_size):
            yield _answered(generate, batch, prompt, kept, output)

    profile = None
    if gpus > 0:
        from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

        executors = ExecutorResourceRequests().resource("gpu", gpus)
        profile = ResourceProfileBuilder().require(executors).require(TaskResourceRequests().cpus(1).resource("gpu", 1)).build
    return df.repartition(slots).mapInPandas(run, df.select(*kept).schema.add(output, "string"), barrier=True, profile=profile)


def infer_where_needed(df: DataFrame, prompt: str, needed: str, known: str, provider: Provider = stub_provider) -> DataFrame:
    """Only rows that need it reach the model; the others keep their known answer as the output."""
    asked = infer(df.where(F.col(needed)), prompt, provider)
    rest = df.where(~F.coalesce(F.col(needed), F.lit(False))).withColumn("raw_output", F.col(known))
    return asked.unionByName(rest)
