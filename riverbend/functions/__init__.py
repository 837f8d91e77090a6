"""The functions of the expression language, one module per category; importing registers them."""

from riverbend.functions import arithmetic, arrays, binary, casts, clock, compare, digests, json, mathematics, objects, outside, randoms, text  # noqa: F401
