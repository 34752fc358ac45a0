"""Declaration of a pyramid: its dimensions, metrics and tiers, with validation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import MONOIDS, Metric

# fixed values: the accepted names of the declaration's closed sets
AXES = ("time", "step")
DIM_TYPES = ("int", "string", "h3", "geohash", "s2")
SCHEMES = ("fixed", "exponential")
ENCODERS = ("interval", "densify")


class SpecError(ValueError):
    """The declaration breaks a rule."""


@dataclass(frozen=True)
class Tier:
    """One resolution: its bin and the ladder of shard durations, ascending."""

    name: str
    bin: str
    shards: tuple[str, ...]


@dataclass(frozen=True)
class Limits:
    """Ceilings of a plan; None means no ceiling."""

    max_output_bins: int | None = None
    max_atoms: int | None = None
    max_keys: int | None = None


@dataclass(frozen=True)
class PyramidSpec:
    """A pyramid; ``tiers`` from the finest to the coarsest."""

    name: str
    tiers: tuple[Tier, ...]
    dims: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    bin_col: str = "ts"
    axis: str = "time"
    key_template: str = "{tier}/{shard}/{period}.parquet"
    dim_types: Mapping[str, str] = field(default_factory=dict)
    geo: Mapping | None = None
    rollup: Mapping | None = None
    multi_scan: Mapping | None = None
    limits: Limits = Limits()

    def tier(self, name: str) -> Tier:
        return next(t for t in self.tiers if t.name == name)

    @property
    def state_columns(self) -> list[str]:
        return [c for m in self.metrics for c in m.columns]


def check_ladder(tier: Tier) -> None:
    """A ladder ascends by nominal width, its first rung holds whole bins and each rung whole rungs of
    the one before (months count in months; beside a calendar rung fixed ones count nominally)."""
    if not tier.shards:
        raise SpecError(f"tier {tier.name}: no shard duration")
    spans = [ta.parse(s) for s in tier.shards]
    if not ta.divides(tier.bin, spans[0]):
        raise SpecError(f"tier {tier.name}: bin {tier.bin} does not divide {spans[0]}")
    for a, b in zip(spans, spans[1:]):
        if b.nominal_ms <= a.nominal_ms:
            raise SpecError(f"tier {tier.name}: {b} does not ascend from {a}")
        if a.calendar == b.calendar:
            fits = ta.divides(a, b)
        else:
            fits = b.nominal_ms % a.nominal_ms == 0
        if not fits:
            raise SpecError(f"tier {tier.name}: {a} does not divide {b}")


def check_window(window: str, spec: PyramidSpec) -> int:
    """The width of a build window in milliseconds: fixed, and whole bins of the finest tier."""
    span, bin_ = ta.parse(window), spec.tiers[0].bin
    if span.calendar:
        raise SpecError(f"window {window} has no fixed width")
    if not ta.divides(bin_, span):
        raise SpecError(f"window {window} is no multiple of the bin {bin_}")
    return span.fixed_ms


def check_template(template: str, ladders: bool) -> None:
    """Rules of key templates: several rungs need ``{shard}``; one hash at most, of 8 to 32 digits."""
    if ladders and "{shard}" not in template:
        raise SpecError("a ladder of several rungs needs {shard} in the key template")
    hashes = re.findall(r"\{hash(?::(\d+))?\}", template)
    if len(hashes) > 1:
        raise SpecError("more than one {hash} in the key template")
    if hashes and hashes[0] and not 8 <= int(hashes[0]) <= 32:
        raise SpecError("{hash:N} needs N from 8 to 32")


def from_mapping(m: Mapping) -> PyramidSpec:
    """A spec from the parsed declaration (YAML or JSON)."""
    axis = m.get("axis", "time")
    if axis not in AXES:
        raise SpecError(f"unknown axis {axis!r}")
    dims = {d["name"]: d.get("type", "string") for d in m.get("dims", [])}
    for name, kind in dims.items():
        if kind not in DIM_TYPES:
            raise SpecError(f"dim {name}: unknown type {kind!r}")
    metrics = tuple(Metric(x["name"], x["monoid"]) for x in m.get("metrics", []))
    for x in metrics:
        if x.monoid not in MONOIDS:
            raise SpecError(f"metric {x.name}: unknown monoid {x.monoid!r}")
    tiers = tuple(Tier(t["name"], t["bin"], tuple(t["shards"])) for t in m["tiers"])
    template = m.get("keyTemplate") or m.get("storage", {}).get("keyTemplate") or PyramidSpec.key_template
    if axis == "time":
        for t in tiers:
            check_ladder(t)
    check_template(template, any(len(t.shards) > 1 for t in tiers))
    geo = m.get("geo")
    if geo:
        res = geo.get("resolutions", [])
        if any(isinstance(r, bool) or not isinstance(r, int) or not 0 <= r <= 30 for r in res) or any(a <= b for a, b in zip(res, res[1:])):
            raise SpecError("geo.resolutions are whole numbers from 0 to 30, strictly descending")
    rollup = m.get("identityRollup")
    if rollup is not None:
        if "map" not in rollup:
            raise SpecError("identityRollup needs a map")
        rollup = {"col": (geo or {}).get("cellCol"), "prefix": "c:", **rollup}
        if not rollup["col"]:
            raise SpecError("identityRollup needs a column")
    scan = m.get("multiScan")
    if scan is not None:
        scheme, encoder = scan.get("scheme", "fixed"), scan.get("encoder", "interval")
        if scheme not in SCHEMES or encoder not in ENCODERS:
            raise SpecError("multiScan: unknown scheme or encoder")
        if scheme == "fixed" and scan.get("groupSize", 1) < 1 or scheme == "exponential" and scan.get("base", 2) < 2:
            raise SpecError("multiScan: groupSize is 1 at least, base 2")
        if not isinstance(scan.get("drop", False), bool):
            raise SpecError("multiScan.drop is true or false")
    return PyramidSpec(m.get("name", "pyramid"), tiers, tuple(dims), metrics, m.get("binCol", "ts"), axis, template, dims, geo, rollup, scan, Limits(**m.get("limits", {})))


def from_text(text: str) -> PyramidSpec:
    """A spec from JSON, or from YAML where a parser for it is installed."""
    import json

    try:
        return from_mapping(json.loads(text))
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise SpecError("reading YAML needs the yaml package") from e
        return from_mapping(yaml.safe_load(text))


def merge_rungs(spec: PyramidSpec, extra: Mapping[str, Sequence[str]]) -> PyramidSpec:
    """The spec with further rungs folded into the ladders of its tiers."""
    tiers = []
    for t in spec.tiers:
        rungs = sorted({*t.shards, *extra.get(t.name, ())}, key=lambda s: ta.parse(s).nominal_ms)
        tiers.append(Tier(t.name, t.bin, tuple(rungs)))
        check_ladder(tiers[-1])
    from dataclasses import replace

    return replace(spec, tiers=tuple(tiers))


def expand_key(template: str, **values: str) -> str:
    """The key of a shard; ``{hash}`` is cut to its length and left out, with its dot, if not given."""
    digest = values.pop("hash", None)

    def put(m: re.Match) -> str:
        name, length = m[1], m[2]
        if name == "hash":
            return (digest or "")[: int(length) if length else 32]
        return str(values[name])

    out = re.sub(r"\{(\w+)(?::(\d+))?\}", put, template)
    return out if digest else out.replace("..", ".")


def parse_key(template: str, key: str) -> dict[str, str] | None:
    """The values of a key, or None if it is none of the template's; a slot's key has no hash."""
    pattern = ""
    for part in re.split(r"(\{\w+(?::\d+)?\})", template):
        m = re.fullmatch(r"\{(\w+)(?::(\d+))?\}", part)
        if not m:
            pattern += re.escape(part)
        elif m[1] == "hash":
            pattern += rf"(?P<hash>[0-9a-f]{{{m[2] or 32}}})"
        else:
            pattern += f"(?P<{m[1]}>[^/]+?)"
    found = re.fullmatch(pattern, key)
    return found.groupdict() if found else None
