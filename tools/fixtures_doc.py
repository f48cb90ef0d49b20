"""Regenerate section 2 of FIXTURES.md (the telemetry relations) from the bindings.

    python tools/fixtures_doc.py
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from opslens.sources.bindings import BINDINGS  # noqa: E402

INTRO = """## 2. Telemetry relations and their bindings

Each relation is `select <expr> as <column>, … from <source> [tail]`, the same text in Spark and DuckDB
(`opslens/sources/bindings.py`; this section is written by `tools/fixtures_doc.py`). Every relation has the fleet key: the last
digit of a key names server (five) and snapshot (two). Date-relative operators use `as_of = timestamp '2001-08-02 00:00:00'`.

Rules kept so that both engines agree: integer arithmetic only with `%`, `*`, `+`; `floor()` before any double→bigint cast (DuckDB
rounds, Spark truncates); no backslash in literals; `string` as text type.
"""


def main() -> None:
    path = os.path.join(ROOT, "FIXTURES.md")
    with open(path) as f:
        text = f.read()
    head, rest = text.split("## 2. Telemetry relations and their bindings", 1)
    cut = rest.find("\n## ")
    parts = [INTRO]
    for name, b in sorted(BINDINGS.items()):
        times = f", each row {b.times[1]} times (`{b.times[0]}`)" if b.times else ""
        parts.append(f"### {name}\n\nfrom `{b.source}`{' `' + b.tail + '`' if b.tail else ''}{times}\n\n| Column | Expression |\n|---|---|")
        parts.append("\n".join(f"| {c} | `{e}` |".replace("||", "\\|\\|") for e, c in ((e, c) for c, e in b.cols)) + "\n")
    with open(path, "w") as f:
        f.write(head + "\n".join(parts) + (rest[cut:] if cut >= 0 else ""))


if __name__ == "__main__":
    main()
