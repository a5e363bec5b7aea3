"""The configuration language of nested maps: [name:"x", recipe:[key:'value']]."""

from __future__ import annotations

import re

_KEY = re.compile(r"[A-Za-z0-9_]+")


class RecipeError(ValueError):
    """Says where reading failed."""


def _until(s: str, at: int, close: str) -> int:
    """Where a value that begins at `at` ends; brackets and quotes nest within brackets."""
    depth, quote = 0, ""
    while at < len(s):
        c = s[at]
        if close == "]":
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "[":
                depth += 1
            elif c == "]":
                if not depth:
                    return at
                depth -= 1
        elif c == "\\":
            at += 1
        elif c == close:
            return at
        at += 1
    raise RecipeError(f"no end of a value at {at}")


def cook(recipe: str) -> dict[str, str]:
    """The keys and values of a recipe; a value in brackets keeps them."""
    out: dict[str, str] = {}
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(recipe) and recipe[at].isspace():
            at += 1

    def need(chars: str, what: str) -> str:
        nonlocal at
        if at >= len(recipe) or recipe[at] not in chars:
            raise RecipeError(f"{what} was expected at {at}")
        at += 1
        return recipe[at - 1]

    blank()
    need("[", "[")
    blank()
    while recipe[at : at + 1] != "]":
        if not (m := _KEY.match(recipe, at)):
            raise RecipeError(f"a key was expected at {at}")
        at = m.end()
        blank()
        need(":", ":")
        blank()
        close = need("'\"[", "a value").replace("[", "]")
        end = _until(recipe, at, close)
        value = recipe[at:end]
        out[m[0]] = f"[{value}]" if close == "]" else re.sub(r"\\(.)", r"\1", value)
        at = end + 1
        blank()
        if recipe[at : at + 1] == "]":
            break
        need(",", ", or ]")
        blank()
    at += 1
    blank()
    if at < len(recipe):
        raise RecipeError(f"text after the end at {at}")
    return out


def _is_recipe(value: str) -> bool:
    try:
        cook(value)
        return True
    except RecipeError:
        return False


def freeze(value: dict[str, str] | str, depth: int = 0) -> str:
    """The text of a map, values that are recipes themselves nested; cook() reads it again."""
    if isinstance(value, str):
        return freeze(cook(value), depth) if _is_recipe(value) else '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'
    pad = "  " * (depth + 1)
    return "[\n" + "".join(f"{pad}{k}:{freeze(v, depth + 1)},\n" for k, v in sorted(value.items())) + "  " * depth + "]"


def unwrap(package: str) -> tuple[str, str]:
    """(name, recipe) of a package."""
    p = cook(package)
    if "name" not in p or "recipe" not in p:
        raise RecipeError("a package has a name and a recipe")
    return p["name"], p["recipe"]


def interpret_option(recipe: str, option: str) -> str:
    """recipe with X's recipe set (X:Z), its name set and recipe cleared (X:name:Z), a value in its recipe set (X:Y:Z), or X wrapped (X@Y)."""
    if not option:
        return recipe
    parts = cook(recipe)
    if option.count("@") == 1:
        key, wrapper = option.split("@")
        if key not in parts:
            raise RecipeError(f"no option {key}")
        return freeze(parts | {key: freeze({"name": wrapper, "recipe": parts[key]})})
    pieces = option.split(":")
    if len(pieces) not in (2, 3):
        raise RecipeError(f"malformed option {option}")
    key, *rest = pieces
    if key not in parts:
        raise RecipeError(f"no option {key}")
    own = cook(parts[key])
    if len(rest) == 1:
        own["recipe"] = rest[0]
    elif rest[0] == "name":
        own |= {"name": rest[1], "recipe": ""}
    else:
        inner = cook(own.get("recipe", ""))
        if rest[0] not in inner:
            raise RecipeError(f"no option {key}:{rest[0]}")
        own["recipe"] = freeze(inner | {rest[0]: rest[1]})
    return freeze(parts | {key: freeze(own)})


def extract_option(recipe: str, option: str) -> str:
    """The recipe of X (X), its name (X:name) or a value in its recipe (X:Y)."""
    key, *rest = option.split(":")
    parts = cook(recipe)
    if key not in parts or len(rest) > 1:
        raise RecipeError(f"no option {option}")
    name, inner = unwrap(parts[key])
    if not rest:
        return inner
    if rest[0] == "name":
        return name
    found = cook(inner)
    if rest[0] not in found:
        raise RecipeError(f"no option {option}")
    return found[rest[0]]
