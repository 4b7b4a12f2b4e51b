"""Generated source trees of any size, the same for a seed on any cluster."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1
_VERBS = ["load", "parse", "store", "check", "merge", "split", "route", "index"]
_NOUNS = ["token", "frame", "graph", "table", "cache", "field", "batch", "scope"]


def mix64(x: int) -> int:
    """One output of the split-mix generator for state x."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def module(seed: int, k: int, files: int) -> str:
    r = mix64(seed ^ k)
    verb, noun, other = _VERBS[r % 8], _NOUNS[(r >> 8) % 8], (r >> 16) % files
    return f"pub struct {noun.title()}{k:05d};\n\nimpl {noun.title()}{k:05d} {{\n    pub fn {verb}(&self) -> u64 {{\n        {r % 997}\n    }}\n}}\n\npub fn {verb}_{noun}_{k}() -> u64 {{\n    helper_{k}() + crate::m{other:05d}::helper_{other}()\n}}\n\npub fn helper_{k}() -> u64 {{\n    {r % 9973}\n}}\n"


def generate(spark: SparkSession, seed: int, files: int) -> DataFrame:
    """path, content of a manifest, a library root and files modules with calls between them."""
    if files < 1:
        raise ValueError("at least one file")

    def run(batches):
        for b in batches:
            ks = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"src/m{k:05d}.rs" for k in ks]), pa.array([module(seed, k, files).encode() for k in ks], pa.binary())], names=["path", "content"])

    head = spark.createDataFrame([("Cargo.toml", b'[package]\nname = "generated"\nversion = "0.0.0"\n'), ("src/lib.rs", "".join(f"pub mod m{k:05d};\n" for k in range(files)).encode())], "path string, content binary")
    return spark.range(files).mapInArrow(run, "path string, content binary").unionByName(head)
