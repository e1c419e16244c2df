"""What a cluster's workers get."""

from __future__ import annotations

import subprocess
import sys

from colloquy import session


def test_the_packed_package_imports_from_elsewhere(tmp_path):
    path = session.packed(str(tmp_path))
    code = f"import sys; sys.path.insert(0, {path!r}); import colloquy.streaming.stateful as s, colloquy.functions.alignment, colloquy.plans.registry as r; assert s.__file__.startswith({path!r}); assert r.QUERIES"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True).returncode == 0
