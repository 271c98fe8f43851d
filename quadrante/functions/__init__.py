from quadrante.functions.numbers import format_number_ptbr, row_sum, row_sum_zero_filled, zero_if_null
from quadrante.functions.text import digits_only, format_cnpj, name_key, order_by_name, trim_blanks

__all__ = [
    "digits_only",
    "format_cnpj",
    "format_number_ptbr",
    "name_key",
    "order_by_name",
    "row_sum",
    "row_sum_zero_filled",
    "trim_blanks",
    "zero_if_null",
]
