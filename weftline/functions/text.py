"""Text functions as SQL expressions: each takes expressions and returns one, so that they nest in lambdas."""

from __future__ import annotations

import json

#: White space as Python's str methods know it: Java's Unicode class and the four separators it lacks.
SPACE = r"[\s\x1c-\x1f]"
SEPARATOR = "<SEP>"


def clean_text(x: str) -> str:
    """Separators and line feeds become spaces, then runs of two or more spaces one; no trimming."""
    return f"regexp_replace(replace(replace(replace({x}, ' {SEPARATOR} ', ' '), '{SEPARATOR}', ' '), '\\n', ' '), ' {{2,}}', ' ')"


def clean_json(x: str, key: str) -> str:
    """JSON text, without needless white space, with every string under the key cleaned, at any depth; what else stands under the key stays.

    Escaped quotes and backslashes become control characters, which such text does not hold, so that quotes
    alone part strings (odd) from structure (even), and no pattern has to walk through a string.
    """
    name = json.dumps(key)[1:-1].replace("\\\\", "\x01").replace('\\"', "\x02").replace("'", "\\'")
    pieces = f"split(replace(replace({x}, r'\\\\', chr(1)), r'\\\"', chr(2)), '\"', -1)"
    text = "regexp_replace(replace(replace(replace(s, ' <SEP> ', ' '), '<SEP>', ' '), r'\\n', ' '), ' {2,}', ' ')".replace("<SEP>", SEPARATOR)
    at_key = f"i % 2 = 1 and i > 2 and p[i - 1] = ':' and p[i - 2] = '{name}'"
    simple = f"transform(p, (s, i) -> if({at_key}, {text}, s))"
    # lists and objects under the key are left alone, whatever they hold: the depth tells where they end
    nested = f"exists(sequence(2, size(p) - 1), i -> i % 2 = 0 and p[i - 1] = '{name}' and p[i] rlike '^:[\\\\[{{]')"
    delta = "case when c in ('[', '{') then 1 when c in (']', '}') then -1 else 0 end"
    # (depth after a piece, least depth within it)
    walk = f"if(i % 2 = 1, named_struct('d', st.depth, 'low', st.depth), aggregate(split(regexp_replace(p[i], r'[^\\[{{\\]}}]', ''), ''), named_struct('d', st.depth, 'low', st.depth), (z, c) -> named_struct('d', z.d + {delta}, 'low', least(z.low, z.d + {delta}))))"
    step = f"""transform(array({walk}), q -> named_struct(
        'out', concat(st.out, array(transform(array(p[i]), s -> if(st.skip < 0 and {at_key}, {text}, s))[0])), 'depth', q.d,
        'skip', case when i % 2 = 1 then st.skip when st.skip >= 0 then if(q.low <= st.skip, -1, st.skip)
                when i > 1 and p[i - 1] = '{name}' and p[i] rlike '^:[\\\\[{{]' and q.d > st.depth then st.depth else -1 end))[0]"""
    careful = f"aggregate(sequence(0, size(p) - 1), named_struct('out', cast(array() as array<string>), 'depth', 0, 'skip', -1), (st, i) -> {step}, st -> st.out)"
    whole = f"transform(array({pieces}), p -> array_join(if(size(p) > 2 and {nested}, {careful}, {simple}), '\"'))[0]"
    return f"replace(replace({whole}, chr(2), r'\\\"'), chr(1), r'\\\\')"


def words(x: str) -> str:
    return f"filter(split({x}, r'(?U){SPACE}+'), w -> w <> '')"


def word_count(x: str) -> str:
    """Tokens between runs of white space."""
    return f"size({words(x)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, r'(?U)\\A{SPACE}+|{SPACE}+\\z', '')"


def normalize(x: str) -> str:
    """Lower case, white space collapsed, then trailing semicolons removed; a space before them stays."""
    return f"regexp_replace(array_join({words(f'lower({x})')}, ' '), r';+\\z', '')"


def slug(x: str) -> str:
    """Base of an action id: stripped, lower case, spaces to underscores, then letters, digits and underscores alone."""
    return f"regexp_replace(replace(lower({strip(x)}), ' ', '_'), r'[^\\p{{L}}\\p{{N}}_]', '')"


def blank(x: str) -> str:
    """Null counts as blank."""
    return f"coalesce({strip(x)}, '') = ''"


def or_null(x: str) -> str:
    """Stripped text, null if nothing is left."""
    return f"nullif({strip(x)}, '')"


def ratio(part: str, whole: str, empty: str = "1.0D") -> str:
    return f"case when {whole} > 0 then cast({part} as double) / {whole} else {empty} end"


def precision_recall(truth: str, found: str) -> tuple[str, str]:
    """Of two sets given as distinct arrays; both empty is perfect, one empty is zero."""
    both = f"size(array_intersect({truth}, {found}))"
    perfect = f"size({truth}) = 0 and size({found}) = 0"
    return tuple(f"case when {perfect} then 1.0D else {ratio(both, f'size({s})', '0.0D')} end" for s in (found, truth))


def f1(p: str, r: str) -> str:
    return f"case when {p} + {r} = 0 then 0.0D else 2 * {p} * {r} / ({p} + {r}) end"
