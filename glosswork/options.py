"""Run options, validated once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

# Operating defaults and limits of the translation service.
MAX_REQUEST_BYTES = 4 * 1024 * 1024
DEFAULT_MAX_BATCH = 4
DEFAULT_WINDOW_MS = 100
DEFAULT_TIMEOUT_S = 240
QUEUE_GRACE_S = 90
DIRECT_TIMEOUT_CAP_S = 270
MIN_TEXT_LENGTH = 5
DEFAULT_REQUEST_MODEL = "codex-cli"
BACKEND_DEFAULT_MODELS = ("codex", "codex-cli", "default")
DEFAULT_MODEL_LABEL = "codex-cli-default"
MODES = ("dual", "mono", "both")
TRANSPORTS = ("bridge", "direct")


@dataclass(frozen=True)
class RunOptions:
    """Everything a corpus run needs besides its tables and its translator.

    ``workers`` is the number of FIFO queues (shards). The service default is
    one; numbering is distributed inside a shard, so one is safe at any size,
    but more shards mean smaller sorts. ``parallelism`` bounds how many backend
    calls are in flight; ``None`` leaves it to Spark. ``ledger`` is a shared folder in
    which replies are recorded as they come (``glosswork.sources.ledger``).
    """

    mode: str = "dual"
    pages: str | None = None
    transport: str = "bridge"
    model: str | None = None
    lang_in: str = "en"
    lang_out: str = "zh"
    min_text_length: int = MIN_TEXT_LENGTH
    translate_table_text: bool = True
    timeout_s: int = DEFAULT_TIMEOUT_S
    max_batch: int = DEFAULT_MAX_BATCH
    window_ms: int = DEFAULT_WINDOW_MS
    workers: int = 1
    parallelism: int | None = None
    ignore_cache: bool = False
    ledger: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.transport not in TRANSPORTS:
            raise ValueError(f"transport must be one of {', '.join(TRANSPORTS)}")
        if self.timeout_s < 1:
            raise ValueError("timeout must be positive")
        if self.transport == "direct" and self.timeout_s > DIRECT_TIMEOUT_CAP_S:
            raise ValueError(
                f"direct transport allows a timeout of at most {DIRECT_TIMEOUT_CAP_S} seconds"
            )
        if not 1 <= self.max_batch <= 64:
            raise ValueError("max_batch must lie in 1..64")
        if not 0 <= self.window_ms <= 5000:
            raise ValueError("window_ms must lie in 0..5000")
        # The desktop limits of 8 and 32 workers bound one machine; on a cluster
        # only the lower end is kept.
        if self.workers < 1:
            raise ValueError("workers must be at least 1")
        if self.parallelism is not None and self.parallelism < 1:
            raise ValueError("parallelism must be at least 1")

    @property
    def batch_limit(self) -> int:
        """Direct transport makes one backend call per segment."""
        return 1 if self.transport == "direct" else self.max_batch

    @property
    def deadline_s(self) -> int:
        """How long a job may wait in the queue before it counts as timed out."""
        return self.timeout_s + QUEUE_GRACE_S
