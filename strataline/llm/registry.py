"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "chat", "licenses", "rans", "bpe", "mixing", "topk", "neardup", "suffix", "wrappers")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"strataline.llm.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
