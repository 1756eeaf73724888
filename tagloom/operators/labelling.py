"""Labels written beside blobs: the first matching rule names a prompt, a model labels the payload in chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_rule


def stub_label(prompt: str, text: str) -> str:
    """A stand-in for a model: the prompt and the most frequent longer words."""
    words = [w.strip(".,;:").lower() for w in text.split() if len(w) > 5]
    top = sorted(set(words), key=lambda w: (-words.count(w), w))[:3]
    return f"{prompt}: {' '.join(top)}"


def chunk_bytes(context: int, prompt: str) -> int:
    """Bytes of a chunk for a context of so many tokens: three quarters of it at three bytes a token, less the prompt."""
    return max(1, context * 3 // 4 * 3 - len(prompt.encode()))


def label_blobs(blobs: DataFrame, rules: list[tuple[str, str]], context: int = 2048, label_fn: Callable[[str, str], str] = stub_label) -> DataFrame:
    """(tag_name, blob_name, payload) of a ``<blob>_label`` for each blob whose name a rule matches.

    Chunks that the model fails on are skipped, labels are joined by a blank line; a blob without any gives none.
    """
    picked = blobs.withColumn("prompt", first_rule(F.col("blob_name"), rules)).where("prompt is not null and payload is not null")

    def run(frames):
        for df in frames:
            out = []
            for tag, name, text, prompt in zip(df["tag_name"], df["blob_name"], df["payload"], df["prompt"]):
                raw, n, labels = bytes(text), chunk_bytes(context, prompt), []
                for i in range(0, len(raw), n):
                    try:
                        labels.append(label_fn(prompt, raw[i : i + n].decode("utf-8", "ignore")))
                    except Exception:  # noqa: BLE001 - a failed chunk never fails the put
                        continue
                if labels:
                    out.append((tag, f"{name}_label", "\n\n".join(labels)))
            yield pd.DataFrame(out, columns=["tag_name", "blob_name", "payload"])

    return picked.select("tag_name", "blob_name", "payload", "prompt").mapInPandas(run, "tag_name string, blob_name string, payload string")
