"""Run configuration, content hashes, manifests and their verification; all on the driver."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "abstract"
    window_sentences: int = 3
    stride_sentences: int = 1
    max_chars: int = 2000

    def __post_init__(self):
        if self.max_chars < 1:
            raise ValueError("max_chars must be at least 1")
        if self.strategy == "sentence_window" and not 1 <= self.stride_sentences <= self.window_sentences:
            raise ValueError("a stride must lie between 1 and the window")


@dataclass(frozen=True)
class RunConfig:
    corpus: str = "documents"
    seed: int = 17
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    lexical: bool = True
    dense: bool = True
    fuse: bool = True
    rerank: bool = True
    pool: int = 10

    def arm(self) -> str:
        """The name of the retrieval arm from its enabled parts."""
        parts = [n for n in ("lexical", "dense", "fuse", "rerank") if getattr(self, n)]
        return "_and_".join(parts) if len(parts) != 1 else parts[0] + "_only"


def canonical_hash(value) -> str:
    """Twelve hexadecimal digits over the value as JSON with sorted keys."""
    plain = dataclasses.asdict(value) if dataclasses.is_dataclass(value) else value
    return hashlib.sha256(json.dumps(plain, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def flat(value, prefix: str = "") -> dict:
    plain = dataclasses.asdict(value) if dataclasses.is_dataclass(value) else value
    out = {}
    for k, v in plain.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def config_diff(a, b) -> dict[str, tuple]:
    """The dotted keys whose values differ, with both values; None where a side lacks the key."""
    x, y = flat(a), flat(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}


def ablate(config: RunConfig, key: str, value) -> RunConfig:
    """The configuration with one dotted key replaced; an unknown key is an error."""
    head, _, rest = key.partition(".")
    if head not in {f.name for f in dataclasses.fields(config)}:
        raise KeyError(key)
    return dataclasses.replace(config, **{head: ablate(getattr(config, head), rest, value) if rest else value})


def write_once(path: Path, content: dict) -> str:
    """Write a JSON file with its content hash; refuses to overwrite."""
    if path.exists():
        raise FileExistsError(path)
    digest = canonical_hash(content)
    path.write_text(json.dumps({**content, "hash": digest}, sort_keys=True, ensure_ascii=False, indent=1))
    return digest


def read_frozen(path: Path) -> dict:
    """Read such a file and verify its hash."""
    got = json.loads(path.read_text())
    digest = got.pop("hash", None)
    if digest != canonical_hash(got):
        raise ValueError(f"{path} does not match its hash")
    return got


def start_run(prefix: str, config: RunConfig, arms: list[str]) -> Path:
    """Write the manifest before any row of the run."""
    path = Path(f"{prefix}.manifest.json")
    write_once(path, {"config": dataclasses.asdict(config), "config_hash": canonical_hash(config), "arms": arms, "started": datetime.now(timezone.utc).isoformat()})
    return path


def verify_run(manifest: dict, rows: int, run_arms: set[str], finished: bool) -> list[str]:
    """The problems of a run: unfinished, arms without rows, rows of foreign arms, no rows."""
    declared = set(manifest.get("arms", []))
    checks = [("unfinished", not finished), ("no rows", rows == 0)]
    out = [name for name, bad in checks if bad]
    out += [f"arm {a} has no rows" for a in sorted(declared - run_arms)]
    out += [f"arm {a} was not declared" for a in sorted(run_arms - declared)]
    return out
