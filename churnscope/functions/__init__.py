from churnscope.functions.numeric import day_number, rounded_fraction, rounded_percent, whole_units
from churnscope.functions.text import normalize_text, text_key

__all__ = [
    "day_number",
    "normalize_text",
    "rounded_fraction",
    "rounded_percent",
    "text_key",
    "whole_units",
]
