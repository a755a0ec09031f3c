"""Driver-side configuration: YAML with ``extends``, spectrogram presets, stable hashes."""

from __future__ import annotations

import hashlib
import json
import os

# The two spectrogram presets.
PRESETS = {
    "aplose_512_98": {"sample_rate": 250, "n_fft": 512, "win_length": 256, "hop_length": 5, "n_mels": 256, "f_min": 0.0, "f_max": 125.0,
        "overlap_percent": 98, "scale": "Default", "frequency_scale": "linear"},
    "aplose_256_90": {"sample_rate": 250, "n_fft": 256, "win_length": 256, "hop_length": 26, "n_mels": 128, "f_min": 0.0, "f_max": 125.0,
        "overlap_percent": 90, "scale": "Default", "frequency_scale": "linear"},
}
#: What a child that names a preset keeps of its parent's audio settings.
KEPT = ("margin_seconds", "normalization", "db_min", "db_max")


def merged(base: dict, over: dict) -> dict:
    """Recursive merge; ``over`` wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_preset(audio: dict) -> dict:
    """Preset values under the explicit ones."""
    name = audio.get("preset")
    if not name:
        return dict(audio)
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(sorted(PRESETS))}")
    return PRESETS[name] | audio


def load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    if parent := own.pop("extends", None):
        beside = os.path.join(os.path.dirname(path), parent)
        base = load(beside if os.path.exists(beside) else parent)  # beside the file, else from the working folder
        if (own.get("audio") or {}).get("preset"):
            base["audio"] = {k: v for k, v in (base.get("audio") or {}).items() if k in KEPT}
        own = merged(base, own)
    return own


def save(config: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False)


def stable_text(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def stable_hash(value) -> str:
    return hashlib.sha1(stable_text(value).encode()).hexdigest()
