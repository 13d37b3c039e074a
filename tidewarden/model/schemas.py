"""Action schemas as documents, and the keys they are stored under."""

from __future__ import annotations

import json

from .fields import ENVELOPE, Field, dictionary

# Sources, their actions, and the attributes of each beyond the envelope.
_PRODUCT = "product_id product_name product_category product_subcategory product_sku product_brand unit_price quantity warranty_period_months"
_ADDRESSES = "delivery_address_line1 delivery_city delivery_country billing_address_line1 billing_city billing_country merchant_id store_id"
_USER = "user_first_name user_last_name user_email user_phone user_gender user_date_of_birth user_nationality opt_in_email opt_in_sms opt_in_push"
ACTIONS = {
    "ecommerce": {
        "add_to_cart": f"cart_id {_PRODUCT}",
        "remove_from_cart": f"cart_id {_PRODUCT}",
        "purchase": f"order_id cart_id order_status discount_amount discount_code tax_amount {_PRODUCT} total_amount currency {_ADDRESSES}",
        "order_created": f"order_id cart_id order_status {_PRODUCT} total_amount currency {_ADDRESSES}",
        "order_shipped": "order_id order_status shipping_method shipping_cost estimated_delivery_date",
        "order_completed": "order_id order_status",
        "order_cancelled": "order_id order_status",
    },
    "crm": {
        "profile_update": _USER,
        "login": "last_login_date",
        "logout": "last_login_date",
        "account_created": f"{_USER} registration_date",
        "account_status_change": "account_id account_status",
        "subscription_change": "account_id subscription_tier loyalty_points",
        "support_ticket_created": "support_ticket_id support_ticket_status",
        "support_ticket_resolved": "support_ticket_id support_ticket_status satisfaction_score",
    },
    "payment": {
        "payment_initiated": "transaction_id payment_gateway payment_method card_network bank_name account_number_hash transaction_status",
        "payment_success": "transaction_id payment_gateway payment_method transaction_status is_3ds_verified billing_zip_match",
        "payment_failed": "transaction_id payment_gateway payment_method transaction_status payment_error_message is_3ds_verified billing_zip_match",
        "refund": "transaction_id payment_gateway transaction_status",
        "chargeback": "transaction_id payment_gateway transaction_status",
    },
}
UNIFIED = "unified_dictionary"


def _definition(field: Field, allowed: tuple[str, ...] = ()) -> dict:
    out: dict = {"type": field.type}
    if field.format:
        out["format"] = field.format
    if allowed or field.allowed:
        out["allowed_values"] = list(allowed or field.allowed)
    for end in ("min", "max"):
        if (value := getattr(field, end)) is not None:
            out[end] = value
    if field.required:
        out["required"] = True
    out["supported_state_strategies"] = list(field.strategies)
    return out


def action_fields(source: str, action: str) -> list[str]:
    return [*ENVELOPE, *ACTIONS[source][action].split()]


def action_schema(source: str, action: str) -> dict:
    """The schema document of one action."""
    fields = dictionary()
    return {"source_name": source, "version": "1.0", "action": action, "fields": {n: _definition(fields[n], tuple(ACTIONS[source]) if n == "event_type" else ()) for n in action_fields(source, action)}}


def unified_schema() -> dict:
    return {"name": UNIFIED, "version": "1.0", "fields": {n: _definition(f) for n, f in dictionary().items()}}


def publisher_key(document: dict) -> str:
    """The key a published document is stored under: a source-level one as ``<source>_schema``."""
    if document.get("name") == UNIFIED:
        return "unified_schema"
    source = document.get("source_name") or "unknown"
    return f"{source}_{document['action']}" if document.get("action") else f"{source}_schema"


def without_descriptions(document: dict) -> dict:
    """The document with ``description`` dropped from each direct child of ``fields``."""
    fields = document.get("fields")
    if not isinstance(fields, dict):
        return document
    return document | {"fields": {n: {k: v for k, v in d.items() if k != "description"} if isinstance(d, dict) else d for n, d in fields.items()}}


def published(document: dict) -> tuple[str, str]:
    """(schema_id, schema_payload): key and minified text without descriptions."""
    return publisher_key(document), json.dumps(without_descriptions(document), separators=(",", ":"), ensure_ascii=False)


def catalog_rows() -> list[tuple[str, str]]:
    """All action schemas as (schema_id, schema_payload)."""
    return [published(action_schema(s, a)) for s in ACTIONS for a in ACTIONS[s]]
