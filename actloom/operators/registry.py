"""Named strategies and their typed settings."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Field:
    """A setting: its kind (text, number, checkbox, select), default, bounds and choices."""

    key: str
    kind: str = "text"
    default: object = None
    required: bool = False
    least: float | None = None
    most: float | None = None
    choices: tuple = ()


class InvalidSetting(ValueError):
    pass


def checked(fields: Iterable[Field], given: dict | None) -> dict:
    """Settings with their defaults; unknown keys are dropped, wrong values raise InvalidSetting. A bool is no number."""
    given = given or {}
    out = {}
    for f in fields:
        value = given.get(f.key)
        if value is None or value == "":
            if f.required and f.default is None:
                raise InvalidSetting(f"{f.key} is required")
            out[f.key] = f.default
            continue
        if f.kind == "number":
            if isinstance(value, bool):
                raise InvalidSetting(f"{f.key} is no number")
            try:
                number = float(value)
            except (TypeError, ValueError):
                raise InvalidSetting(f"{f.key} is no number") from None
            if f.least is not None and number < f.least or f.most is not None and number > f.most:
                raise InvalidSetting(f"{f.key} is out of bounds")
            value = int(number) if number == int(number) else number
        elif f.kind == "checkbox" and not isinstance(value, bool):
            raise InvalidSetting(f"{f.key} is neither true nor false")
        elif f.kind == "select" and value not in f.choices:
            raise InvalidSetting(f"{f.key} is none of its choices")
        elif f.kind == "text" and not isinstance(value, str):
            raise InvalidSetting(f"{f.key} is no text")
        out[f.key] = value
    return out


@dataclass
class Strategy:
    name: str
    label: str
    make: Callable
    fields: tuple[Field, ...] = ()


@dataclass
class Registry:
    """Strategies by name; the first of a name wins, a broken one is logged and left out."""

    kind: str
    items: dict[str, Strategy] = field(default_factory=dict)

    def add(self, make: Callable[[], Strategy]) -> None:
        try:
            found = make()
        except Exception:  # noqa: BLE001 - a broken plugin must not break the others
            log.exception("a %s could not be loaded", self.kind)
            return
        self.items.setdefault(found.name, found)

    def listed(self) -> list[Strategy]:
        return [self.items[k] for k in sorted(self.items)]

    def get(self, name: str) -> Strategy:
        if name not in self.items:
            raise ValueError(f"no such {self.kind}: {name}")
        return self.items[name]

    def build(self, name: str, settings: dict | None = None):
        own = self.get(name)
        return own.make(**checked(own.fields, settings))


SIZES = (Field("chunk_size", "number", 1200, least=1), Field("chunk_overlap", "number", 150, least=0))
WINDOWS = (Field("window_size", "number", 200, least=1), Field("step_size", "number", 100, least=1))


def chunkers() -> Registry:
    """The chunkers that split one text at a time."""
    from actloom.operators import chunkers as c

    out = Registry("chunker")
    sized = lambda make: lambda chunk_size=1200, chunk_overlap=150: make(chunk_size, chunk_overlap)
    for name, label in (("text_recursive", "Recursive"), ("text_markdown", "Markdown"), ("text_sentence", "Sentences"), ("text_fixed", "Fixed size")):
        out.add(lambda name=name, label=label: Strategy(name, label, sized(c.STRATEGIES[name]), SIZES))
    out.add(lambda: Strategy("text_sliding_window", "Sliding window", c.STRATEGIES["text_sliding_window"], WINDOWS))
    out.add(lambda: Strategy("text_section", "Section (headers)", c.STRATEGIES["text_section"]))
    out.add(lambda: Strategy("legal_xml", "Act structure", c.STRATEGIES["legal_xml"]))
    return out


def register_functions(spark) -> None:
    """The chunkers as table functions of SQL, `chunk_<name>(text[, settings as JSON])`.

    They are evaluated in Arrow batches of rows.
    """
    import json

    from pyspark.sql.functions import udtf

    def table_function(own: Strategy):
        class Chunks:
            def __init__(self):
                self.made: dict = {}

            def eval(self, text: str, settings: str = None):
                if text and text.strip():
                    if settings not in self.made:
                        self.made[settings] = own.make(**checked(own.fields, json.loads(settings) if settings else {}))
                    for k, row in enumerate(self.made[settings](text, None)):
                        yield (k, row[0], row[1], row[2], row[3], row[4])

        return udtf(Chunks, returnType="chunk_index int, text string, start_offset int, end_offset int, chunk_type string, metadata string", useArrow=True)

    for own in chunkers().listed():
        spark.udtf.register(f"chunk_{own.name}", table_function(own))


def discover(package, kind: str) -> Registry:
    """The strategies that the modules of a package hold, by walking through it; a module that can't be imported is logged and left out.

    Modules and their names are gone through in order, and the first of a name wins.
    """
    import importlib
    import pkgutil

    out = Registry(kind)
    for info in sorted(pkgutil.walk_packages(package.__path__, f"{package.__name__}."), key=lambda x: x.name):
        try:
            module = importlib.import_module(info.name)
        except Exception:  # noqa: BLE001 - a broken plugin must not break the others
            log.exception("%s could not be loaded", info.name)
            continue
        for name in sorted(vars(module)):
            if isinstance(own := getattr(module, name), Strategy):
                out.add(lambda own=own: own)
    return out


KEYWORDS = (Field("enabled", "checkbox", False), Field("include_keywords", "text", ""), Field("exclude_keywords", "text", ""))


def listed_keywords(text: str | None) -> list[str]:
    """Keywords of a setting, parted by commas or line ends."""
    return [x.strip() for x in (text or "").replace("\n", ",").split(",") if x.strip()]


def registries() -> dict[str, Registry]:
    """All kinds of strategies: sources, validators, filters, parsers, chunkers and embedders, each by its names."""
    from actloom.functions.text import relevant, strip
    from actloom.operators import providers, stages
    from actloom.operators.links import same_origin
    from actloom.sources import fetch, files, parsers

    def filtering(enabled=False, include_keywords="", exclude_keywords=""):
        return lambda title, text: relevant(title, text, enabled, listed_keywords(include_keywords), listed_keywords(exclude_keywords))

    made = {
        "source": (Strategy("web", "Web pages", lambda: fetch.fetch), Strategy("local", "Local acts", lambda: files.read_acts)),
        "validator": (Strategy("web", "Same origin", lambda: same_origin), Strategy("local", "Local file", lambda: stages.validated_local)),
        "filter": (Strategy("keyword", "Keywords", filtering, KEYWORDS),),
        "parser": (Strategy("plain", "Plain text", lambda: strip), Strategy("html", "HTML", lambda: parsers.html_text), Strategy("xml", "XML", lambda: parsers.xml_text)),
        "embedder": (Strategy("standard", "Model of a provider", lambda provider=None: providers.Embedder(providers.target_of(provider))),),
    }
    out = {"chunker": chunkers()}
    for kind, own in made.items():
        out[kind] = Registry(kind)
        for x in own:
            out[kind].add(lambda x=x: x)
    return out
