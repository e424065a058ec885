"""Text expressions of the DuckDB side, written for its own functions."""

WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_BLANKS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(5760)||"
    + "||".join(f"chr({n})" for n in range(0x2000, 0x200B))
    + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"
)


def trim(e: str) -> str:
    return f"trim(coalesce({e}, ''), {_BLANKS})"


def squash(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '[{WS}]+', ' ', 'g'), ' ')"


def default(e: str, value: str) -> str:
    return f"coalesce(nullif({e}, ''), '{value}')"


def slug(e: str) -> str:
    return default(f"trim(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]+', '_', 'g'), '_')", "other")


def decode(e: str) -> str:
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">")]:
        e = f"replace({e}, '{entity}', '{char}')"
    return e


def strip(e: str) -> str:
    return decode(squash(f"regexp_replace(coalesce({e}, ''), '<[^>]+>', ' ', 'g')"))


def words(e: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"


def tokens(e: str) -> str:
    return (
        f"list_distinct(list_filter(string_split({words(e)}, ' '), lambda t: length(t) > 2))"
    )


_DOT = r"(\.|%2e)"
_SAFE = "!$-;=@-_a-z|~"


def without_dots(e: str) -> str:
    """A path with its dot segments resolved."""
    return (
        f"list_reduce(list_prepend('', string_split(substr({e}, 2), '/')), lambda a, s: "
        f"case when regexp_matches(s, '^{_DOT}$', 'i') then a "
        f"when regexp_matches(s, '^{_DOT}{_DOT}$', 'i') then regexp_replace(a, '/[^/]*$', '') else a || '/' || s end)"
    )


def escape_path(e: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({e}, '[^{_SAFE}]|[{_SAFE}]+'), "
        f"lambda c: case when regexp_matches(c, '^[{_SAFE}]+$') then c else url_encode(c) end), '')"
    )


def code_units(e: str) -> str:
    return f"(length({e}) + length(regexp_replace({e}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def product_url(e: str, prefix: str) -> str:
    """Normalised product URL against https://shop.example.com."""
    raw = f"regexp_replace(coalesce({e}, ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
    raw = f"translate({raw}, chr(9) || chr(10) || chr(13), '')"
    front = f"regexp_extract({raw}, '^[^?#]*')"
    raw = f"(replace({front}, chr(92), '/') || substr({raw}, length({front}) + 1))"
    full = (
        f"case when regexp_matches({raw}, '^https?://', 'i') then {raw} when {raw} like '//%' then 'https:' || {raw} "
        f"when {raw} like '/%' then 'https://shop.example.com' || {raw} "
        f"when {raw} = '' or regexp_matches({raw}, '^[A-Za-z][A-Za-z0-9+.-]*:') then '' "
        f"else 'https://shop.example.com/' || {raw} end"
    )
    clean = f"regexp_extract({full}, '^([^?#]*)', 1)"
    host = f"lower(regexp_extract({clean}, '^[a-zA-Z]+://[^/]*', 0))"
    host = f"regexp_replace({host}, '//[^@]*@', '//')"
    host = f"case when {host} like 'https:%' then regexp_replace({host}, ':443$', '') else regexp_replace({host}, ':80$', '') end"
    path = f"regexp_extract({clean}, '^[a-zA-Z]+://[^/]*(/.*)$', 1)"
    path = f"rtrim({escape_path(without_dots(path))}, '/')"
    return (
        f"case when regexp_matches({path}, '^{prefix}/[^/?#]+\\.html$', 'i') or "
        f"regexp_matches({path}, '^{prefix}/catalog/product/view/id/[0-9]+(/.*)?$', 'i') "
        f"then ({host}) || {path} else '' end"
    )
