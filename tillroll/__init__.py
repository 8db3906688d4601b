"""tillroll — a shop's standing sales reports as Spark DataFrame plans."""

from .model import DEFAULT, Params, Shop

__all__ = ["DEFAULT", "Params", "Shop"]
