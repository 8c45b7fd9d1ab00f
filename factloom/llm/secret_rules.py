"""Rules for secrets, and the Boolean trigram query that each regex implies."""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as P

#: Fixed values, base kinds first: kind, pattern, the group whose length counts, its least length.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 1),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("payment", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("private_key", r"-----BEGIN\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----", 0, 1),
    ("package", r"npm_[A-Za-z0-9]{36}", 0, 1),
    ("index", r"pypi-AgE[A-Za-z0-9_-]{32,}", 0, 1),
    ("mail_key", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}", 0, 1),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 1),
    ("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+", 0, 1),
)
BASE = 3
#: Rules whose letters match in either case (in their words, not in a value).
ANY_CASE = {"assign"}
#: Literal sets over this size, and trigrams of one alternative over this number, are not followed further.
MOST_LITERALS, MOST_TRIGRAMS = 24, 3


def _literals(node) -> set[str] | None:
    """The strings that a parsed node can be, in lower case, if they are few; else None."""
    op, value = node
    if op is C.LITERAL:
        return {chr(value).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, v in value:
            if kind is C.LITERAL:
                out.add(chr(v).lower())
            elif kind is C.RANGE and v[1] - v[0] < MOST_LITERALS:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 5 else None
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is C.MAX_REPEAT and value[1] <= 2:
        inner = _sequence(value[2])
        return None if inner is None else {"".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        some = _literals(node)
        if some is None or len(out) * len(some) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in some}
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """All of these groups must hold; a group holds if all trigrams of one of its alternatives stand in the lower-cased text.

    A group is a stretch of the pattern that can be a few strings only, each of three characters or more. No group: the
    pattern says nothing of trigrams.
    """
    runs, run = [], {""}
    for node in [*P.parse(pattern), None]:
        some = _literals(node) if node else None
        if some is not None and len(run) * len(some) <= MOST_LITERALS:
            run = {a + b for a in run for b in some}
        else:
            runs.append(run)
            run = some if some is not None else {""}
    groups = []
    for run in runs:
        if all(len(s) >= 3 for s in run):
            alternatives = []
            for s in sorted(run):
                grams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
                step = max(1, -(-len(grams) // MOST_TRIGRAMS))
                alternatives.append(grams[::step])
            groups.append(alternatives)
    return groups
