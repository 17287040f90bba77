"""Parameters of a capture run, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Cut used where the cut itself is what is shown (tokenize_truncate, valid_lengths).
SHORT_LENGTH = 4096

SLIDING = "sliding_attention"
FULL = "full_attention"
KINDS = ("q", "k")


@dataclass(frozen=True)
class Layout:
    """Head layout of one model."""

    q_heads: int = 4
    k_heads: int = 2
    head_dim: int = 16
    layer_types: tuple[str, ...] = (FULL, SLIDING, FULL, SLIDING)
    sliding_window: int = 64

    def __post_init__(self) -> None:
        if self.q_heads % self.k_heads:
            raise ValueError(
                f"q heads must be a multiple of k heads, got {self.q_heads} and {self.k_heads}"
            )

    @property
    def num_layers(self) -> int:
        return len(self.layer_types)

    @property
    def queries_per_key(self) -> int:
        return self.q_heads // self.k_heads

    def heads(self, kind: str) -> int:
        return self.q_heads if kind == "q" else self.k_heads

    def window(self, layer: int) -> int | None:
        return self.sliding_window if self.layer_types[layer] == SLIDING else None


@dataclass(frozen=True)
class CaptureSettings:
    """What to sample and how; the defaults are those of the registered queries."""

    strategy: str = "uniform"
    base_rate: float = 1.0
    bucket_size: int = 64
    seed: int = 0
    max_length: int | None = None  # sequences are cut only if asked for
    max_rows: int | None = None
    layers: tuple[int, ...] | None = None
    heads: tuple[int, ...] | None = None
    kinds: tuple[str, ...] = KINDS
    full_attention_only: bool = False
    layout: Layout = Layout()


LAYOUT = Layout()
SETTINGS = CaptureSettings()
BATCH_SIZE = 64
HEAD_SAMPLE = 6
MAX_SAMPLES = 500
ROW_CAP = 4
# Attention joins are cut into key tiles of this many positions.
KEY_TILE = 4096
SOFTCAP = 50.0
ROPE_THETA = 10000.0
SLIDING_ROPE_THETA = 1000.0
QUERY_SCALE_BETA = 0.1
QUERY_SCALE_LENGTH = 256
RMS_EPS = 1e-6
