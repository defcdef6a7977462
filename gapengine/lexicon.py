"""Word lists, as parameters of the operators that use them. These are our own; every operator takes others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Lexicon:
    positive: frozenset[str] = frozenset("good great love nice helpful easy fast excellent perfect awesome useful thanks works best happy smooth".split())
    negative: frozenset[str] = frozenset("bad terrible hate awful useless slow broken worst annoying poor horrible disappointing frustrating buggy ugly".split())
    intense: frozenset[str] = frozenset("very really extremely totally completely always never absolutely constantly".split())
    friction: frozenset[str] = frozenset("crash crashes bug error fail fails failed missing cannot unable freeze stuck lost lag login delete wrong problem issue".split())
    phrases: tuple[str, ...] = (r"(?:does|do|did)(?:n.t| not) (?:work|load|open|save)", r"(?:can|could)(?:n.t| ?not) ", r"please (?:add|fix|bring)", r"wish (?:it|there|you)")
    stop: frozenset[str] = frozenset("the and for with this that from have was are but not you your all can has its app will when what just they there been also more than then them into out our".split())
    weak: frozenset[str] = frozenset("time thing way lot".split())
    domains: dict[str, frozenset[str]] = field(default_factory=lambda: {"access": frozenset("login password account sign session token".split()), "content": frozenset("post draft editor publish image upload page".split()), "stability": frozenset("crash freeze error bug lag stuck".split())})
    templates: dict[str, tuple[str, str]] = field(default_factory=lambda: {"access": ("Dependable access to the account", "When I come back, I want to get in at once, so that I can go on"), "content": ("Confidence that written work is kept", "When I write, I want my work saved, so that nothing is lost"), "stability": ("An application that keeps running", "When I rely on it, I want it to keep running, so that I can finish")})

    def domain_words(self, spark: SparkSession) -> DataFrame:
        """(domain, word)."""
        return spark.createDataFrame(sorted((d, w) for d, words in self.domains.items() for w in words), "domain string, word string")


DEFAULT = Lexicon()
