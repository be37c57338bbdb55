"""Small inputs that a driver holds: composed configurations, and taxonomies as tables."""

from __future__ import annotations

import copy
import hashlib

from pyspark.sql import DataFrame, SparkSession


def compose(base: dict, *layers: dict, override: dict[str, object] | None = None) -> dict:
    """base with layers merged over it in order, then dotted overrides, whose keys must exist already (KeyError)."""
    out = copy.deepcopy(base)

    def merge(into: dict, layer: dict) -> None:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                merge(into[k], v)
            else:
                into[k] = copy.deepcopy(v)

    for layer in layers:
        merge(out, layer)
    for dotted, value in (override or {}).items():
        *path, last = dotted.split(".")
        at = out
        for k in path:
            if not isinstance(at.get(k), dict):
                raise KeyError(dotted)
            at = at[k]
        if last not in at:
            raise KeyError(dotted)
        at[last] = value
    return out


def taxonomy(spark: SparkSession, tree: dict[str, dict[str, list[str]]]) -> tuple[DataFrame, str]:
    """(position, domain, subdomain, leaf) in the tree's order, and a SHA-256 over the newline-joined keys."""
    rows = [(a, b, leaf) for a, subs in tree.items() for b, leaves in subs.items() for leaf in leaves]
    digest = hashlib.sha256("\n".join("/".join(r) for r in rows).encode()).hexdigest()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, domain string, subdomain string, leaf string"), digest


def read_yaml(uri: str) -> dict:
    """A YAML file as a dict; needs the yaml package, which not every installation has."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    from .files import read_bytes

    return yaml.safe_load(read_bytes(uri)) or {}


def composed_files(base: str, *layers: str, override: dict[str, object] | None = None) -> dict:
    """compose() over YAML files."""
    return compose(read_yaml(base), *map(read_yaml, layers), override=override)


def taxonomy_file(spark: SparkSession, uri: str) -> tuple[DataFrame, str]:
    """taxonomy() of a YAML file."""
    return taxonomy(spark, read_yaml(uri))
