"""The SQL surface: text of a dialect in, Spark SQL text out."""

from .lexer import Token, tokenize
from .translate import Translator, translate

__all__ = ["Token", "Translator", "tokenize", "translate"]
