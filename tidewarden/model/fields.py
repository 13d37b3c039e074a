"""The dictionary of event attributes.

Each line of the table names a field, its type and its constraints: ``required``,
``format=``, ``in=`` (allowed values), ``min=`` and ``max=``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import types as T

# The 66 fields with their declared types and constraints.
_TABLE = """
event_id string required format=UUID
event_type string required
entity_id string required
source_system string required in=ecommerce,crm,payment
schema_version string
event_time string required format=ISO-8601
source_id string
trace_id string format=UUID
correlation_id string format=UUID
user_first_name string
user_last_name string
user_email string format=Email
user_phone string format=E.164
user_gender string in=M,F,O,U
user_date_of_birth string format=YYYY-MM-DD
user_nationality string
account_id string
account_status string in=active,suspended,deleted
registration_date string format=ISO-8601
last_login_date string format=ISO-8601
subscription_tier string in=free,basic,premium,vip,enterprise
loyalty_points integer min=0
opt_in_email boolean
opt_in_sms boolean
opt_in_push boolean
support_ticket_id string
support_ticket_status string
satisfaction_score integer min=1 max=5
product_id string
product_name string
product_category string in=electronics,fashion,food,books,home,sports,beauty,automotive
product_subcategory string
product_sku string
product_brand string
unit_price double min=0.0
quantity integer min=1
discount_amount double min=0.0
discount_code string
tax_amount double min=0.0
total_amount double min=0.0
currency string
cart_id string
order_id string
order_status string in=created,paid,shipped,completed,cancelled
shipping_method string in=standard,express,next_day
shipping_cost double min=0.0
delivery_address_line1 string
delivery_city string
delivery_country string
estimated_delivery_date string format=YYYY-MM-DD
billing_address_line1 string
billing_city string
billing_country string
merchant_id string
store_id string
warranty_period_months integer min=0
transaction_id string
payment_gateway string in=stripe,paypal,vnpay,momo
payment_method string in=credit_card,wallet,bank_transfer,cod
card_network string in=visa,mastercard,amex,discover,jcb
bank_name string
account_number_hash string
transaction_status string in=pending,success,failed,reversed
payment_error_message string
is_3ds_verified boolean
billing_zip_match boolean
"""

# What each format looks like.
FORMATS = {
    "UUID": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "Email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "E.164": r"^\+[1-9][0-9]{1,14}$",
    "ISO-8601": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$",
    "YYYY-MM-DD": r"^\d{4}-\d{2}-\d{2}$",
}

ENVELOPE = ("event_id", "event_type", "entity_id", "source_system", "schema_version", "event_time", "source_id", "trace_id", "correlation_id")
FUNCTIONS = ("SUM", "COUNT", "AVG", "MAX", "MIN")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    format: str | None = None
    allowed: tuple[str, ...] = ()
    min: float | None = None
    max: float | None = None

    @property
    def strategies(self) -> tuple[str, ...]:
        """Aggregates the field supports: all for numbers, ends for dates, else last value and count."""
        common = ("last_value", "count")
        if self.type in ("integer", "double"):
            return (*common, "sum", "avg", "max", "min")
        return (*common, "max", "min") if self.format in ("ISO-8601", "YYYY-MM-DD") else common

    @property
    def spark_type(self) -> T.DataType:
        return {"integer": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}.get(self.type, T.StringType())


def _parse(line: str) -> Field:
    name, kind, *rest = line.split()
    given = dict(re.match(r"([^=]+)=?(.*)", x).groups() for x in rest)
    number = {k: float(given[k]) for k in ("min", "max") if k in given}
    return Field(name, kind, "required" in given, given.get("format"), tuple(given["in"].split(",")) if "in" in given else (), **number)


@lru_cache(maxsize=1)
def dictionary() -> dict[str, Field]:
    """All fields by name, in order."""
    return {f.name: f for f in map(_parse, _TABLE.strip().splitlines())}


def required_names() -> list[str]:
    return [f.name for f in dictionary().values() if f.required]


def attributes_type() -> T.StructType:
    """A nullable struct of all fields for typed work."""
    return T.StructType([T.StructField(f.name, f.spark_type) for f in dictionary().values()])
