"""Scalar rules as Column expressions, without UDFs. staged() computes rules step by step, so that tables get them by generated code."""

from ledgerloom.functions.calendar import DATE, report_date, to_date
from ledgerloom.functions.codes import BRAND, MATCH_KEY, MODALITY, NSU, authorization, authorization_rule, brand, identifier, match_key, modality, nsu, payment_form, payment_form_rule, service_order
from ledgerloom.functions.installments import criterion, installment, installment_rule, remaining
from ledgerloom.functions.money import AMOUNT, brazilian, to_money
from ledgerloom.functions.text import FOLD, FOLDED_TEXT, TEXT, Rule, blank, fold, staged, stripped, text_or_null

__all__ = [
    "AMOUNT", "BRAND", "DATE", "FOLD", "FOLDED_TEXT", "MATCH_KEY", "MODALITY", "NSU", "Rule", "TEXT", "authorization", "authorization_rule", "blank", "brand", "brazilian", "criterion", "fold",
    "identifier", "installment", "installment_rule", "match_key", "modality", "nsu", "payment_form", "payment_form_rule", "remaining", "report_date", "service_order", "staged", "stripped",
    "text_or_null", "to_date", "to_money",
]
