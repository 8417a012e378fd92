"""Every global name that a function of the library uses exists."""

from __future__ import annotations

import builtins
import importlib
import pkgutil
import types

import pytest

import tracewright

MODULES = [m.name for m in pkgutil.walk_packages(tracewright.__path__, "tracewright.")]


def codes(code: types.CodeType):
    yield code
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from codes(c)


def globals_of(code: types.CodeType):
    import dis

    return {i.argval for c in codes(code) for i in dis.get_instructions(c) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME")}


@pytest.mark.parametrize("name", MODULES)
def test_names(name):
    module = importlib.import_module(name)
    with open(module.__file__) as f:
        code = compile(f.read(), module.__file__, "exec")
    for c in codes(code):
        if c.co_name == "<module>" or c.co_flags & 2 == 0:  # module and class bodies have names of their own
            continue
        missing = {n for n in globals_of(c) if n not in vars(module) and not hasattr(builtins, n)}
        assert not missing, (name, c.co_name, missing)
