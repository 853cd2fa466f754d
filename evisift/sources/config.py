"""Settings of a run, from a file of KEY=value lines and the environment. They stay with the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

NEEDED = ("LLM_MODEL", "LLM_API_BASE", "LLM_API_KEY")


@dataclass(frozen=True)
class ModelSettings:
    model_name: str
    api_base: str
    api_key: str
    timeout_seconds: int = 120
    temperature: float = 0.0

    def public(self) -> dict:
        """As a dict that may be shown: without the key."""
        return asdict(self) | {"api_key": "<redacted>"}

    def public_json(self) -> str:
        return json.dumps(self.public(), ensure_ascii=False, indent=2)


def read_env(path: str | os.PathLike) -> dict[str, str]:
    """KEY=value lines, without blank ones and comments; quotes around values are taken off. The environment's values go before the file's."""
    out: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            if (line := line.strip()) and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip().strip("\"'")
    return out | {k: os.environ[k] for k in NEEDED if os.environ.get(k)}


def model_settings(env: dict[str, str]) -> ModelSettings | None:
    """None unless name, base address and key are all there."""
    name, base, key = (env.get(k, "") for k in NEEDED)
    return ModelSettings(name, base, key) if name and base and key else None
