"""Names that carry parameters, and rules that read names."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import singledispatch

# Parameters that names carry, in the order in which they appear, with their codes.
CODES = {
    "merge_function": "mf",
    "threshold": "t",
    "global_bias": "gb",
    "fragments_in_xy": "xy",
    "min_seed_distance": "msd",
    "seed_eps": "seps",
    "epsilon_agglomerate": "ea",
    "sigma": "sig",
    "noise_eps": "eps",
    "bias": "b",
    "strides": "st",
    "randomized_strides": "rs",
    "filter_fragments": "ff",
    "remove_debris": "rd",
}


#: What parts the items of a list, and of the lists inside it.
SEPARATORS = ("_", ".")


@singledispatch
def spelled(value, depth: int = 0) -> str:
    """A parameter as names spell it: a switch says only that it is off, numbers are short, a list of equal items is one of them."""
    return str(value)


@spelled.register
def _(value: bool, depth: int = 0) -> str:
    return str(value) if depth else "" if value else "0"


@spelled.register
def _(value: float, depth: int = 0) -> str:
    return format(value, "g")


@spelled.register(list)
@spelled.register(tuple)
def _(value, depth: int = 0) -> str:
    items = {k: spelled(x, depth + 1) for k, x in enumerate(value)}
    return SEPARATORS[min(depth, 1)].join(items.values()) if len({*items.values()}) != 1 else items[0]


def build_name(params: Mapping, codes: Mapping[str, str] = CODES) -> str:
    """A name that depends on the parameters alone: those that are set, each as its code and value, in the codes' order."""
    set_ = (c for c in codes if params.get(c) is not None)
    return "--".join(map(lambda c: codes[c] + spelled(params[c]), set_))


def provenance(params: Mapping) -> dict[str, str]:
    """Parameters as a map of JSON texts, the form in which tables carry them."""
    return {str(k): json.dumps(v, sort_keys=True, default=str) for k, v in sorted(params.items())}


def default_output(name: str, suffix: str) -> str:
    """``<container>/<name>_<suffix>`` for an input inside a container; an error without one."""
    head, sep, tail = name.partition(".zarr/")
    if not sep or not tail.strip("/"):
        raise ValueError(f"{name} names no dataset in a container; give the output")
    return f"{head}{sep}{tail.strip('/')}_{suffix}"


def is_label_dataset(name: str, dtype: str) -> bool:
    """Whether a dataset holds ids: unsigned integers of 32 or 64 bits, or a name that says so."""
    return dtype in ("uint32", "uint64") or bool(re.search(r"label|lbl|ids|mask|seg", name.lower()))


def error_metric(name: str) -> str:
    """Which error map a prediction's name asks for."""
    for kind in ("lsd", "aff"):
        if kind in name.rsplit("/", 1)[-1]:
            return kind
    raise ValueError(f"{name} names neither affinities nor descriptors")


def natural_key(name: str) -> list:
    """Sorts digits as numbers."""
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def latest_checkpoint(names: list[str]) -> str | None:
    return max(names, key=natural_key, default=None)


def pyramid_level(name: str) -> int | None:
    m = re.fullmatch(r"s(\d+)", name.rsplit("/", 1)[-1])
    return int(m[1]) if m else None


def compatible_chain(model: str, previous: str) -> bool:
    """Whether a model that refines another's output may follow it: what stands after ``_from_`` is in its name."""
    _, sep, source = model.partition("_from_")
    return bool(sep) and source in previous


def datasets_under(names: list[str], prefix: str) -> list[str]:
    """Segmentations under a prefix, sorted; comparisons of two (``__vs__``) are not among them."""
    return sorted(n for n in names if n.startswith(prefix) and "__vs__" not in n)
