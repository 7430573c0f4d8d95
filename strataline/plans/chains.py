"""Named chains, an interpreter for lists of operations, a line language for them, and sessions of named frames."""

from __future__ import annotations

import inspect
import re
import uuid

from strataline.frame import SignalFrame

#: Operations that a list or line may name.
OPERATIONS = frozenset(
    "slice astype scale abs detrend demean normalize integrate differentiate median_filter spatial_smooth sta_lta template_match bandpass bandstop lowpass highpass notch process_differential integrate_data hilbert envelope fk_filter threshold_detect rms to_standard_units convert_units".split()
)
#: Names and steps of the recipes. (fixed values)
RECIPES: dict[str, list[dict]] = {
    "standard_denoise": [{"op": "detrend"}, {"op": "highpass", "cutoff": 1.0}],
    "remove_powerline": [{"op": "detrend"}],
    "seismic_enhance": [{"op": "detrend"}, {"op": "bandpass", "low": 1.0, "high": 100.0}, {"op": "normalize", "method": "zscore"}],
}


def process(frame: SignalFrame, operations: list[dict]) -> SignalFrame:
    """Apply operations ({"op": name, further arguments}) in order."""
    for step in operations:
        name, args = step.get("op"), {k: v for k, v in step.items() if k != "op"}
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name}")
        frame = getattr(frame, name)(**args)
    return frame


def schemas(style: str = "function") -> list[dict]:
    """JSON descriptions of the operations for a language model that may name them: as functions, or as tools with an input schema."""
    kinds = {"float": "number", "int": "integer", "str": "string", "bool": "boolean"}
    out = []
    for name in sorted(OPERATIONS):
        method = getattr(SignalFrame, name)
        args = {k: p for k, p in inspect.signature(method).parameters.items() if k != "self"}
        shape = {
            "type": "object",
            "properties": {k: {"type": kinds.get(str(p.annotation).split(" |")[0], "string")} | ({} if p.default in (p.empty, None) else {"default": p.default} if not isinstance(p.default, slice) else {}) for k, p in args.items()},
            "required": [k for k, p in args.items() if p.default is p.empty],
        }
        text = (inspect.getdoc(method) or name.replace("_", " ")).split("\n")[0]
        out.append({"type": "function", "function": {"name": name, "description": text, "parameters": shape}} if style == "function" else {"name": name, "description": text, "input_schema": shape})
    return out


def clean(frame: SignalFrame, recipe: str) -> SignalFrame:
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe}")
    return process(frame, RECIPES[recipe])


def parse(line: str) -> list[dict]:
    """``detrend | bandpass low=1 high=20 | normalize method=zscore`` as a list of operations."""
    out = []
    for part in filter(None, (p.strip() for p in line.split("|"))):
        name, *args = part.split()
        step: dict = {"op": name}
        for a in args:
            key, eq, value = a.partition("=")
            if not eq:
                raise ValueError(f"an argument needs a name: {a}")
            step[key] = int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value) if re.fullmatch(r"[+-]?\d*\.\d+(?:e[+-]?\d+)?", value) else value
        out.append(step)
    return out


class Session:
    """Frames by id; each is also a temporary view, so that SQL reaches it."""

    def __init__(self):
        self._held: dict[str, tuple[SignalFrame, dict]] = {}

    def store(self, frame: SignalFrame, **meta) -> str:
        name = f"data_{uuid.uuid4().hex[:8]}"
        frame.df.createOrReplaceTempView(name)
        self._held[name] = (frame, meta)
        return name

    def get(self, name: str) -> SignalFrame:
        return self._held[name][0]

    def metadata(self, name: str) -> dict:
        return self._held[name][1]

    def list(self) -> dict[str, dict]:
        return {k: m for k, (_, m) in self._held.items()}

    def delete(self, name: str) -> None:
        frame, _ = self._held.pop(name)
        frame.df.sparkSession.catalog.dropTempView(name)

    def clear(self) -> int:
        n = len(self._held)
        for name in [*self._held]:
            self.delete(name)
        return n

    def process(self, name: str, operations: list[dict]) -> str:
        return self.store(process(self.get(name), operations), source=name, operations=operations)
