"""Personal-data rules as Spark expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Labels, patterns and limits that results depend on. A name takes the label of the first pattern
# in this list that it matches.
NAME_PATTERNS = [
    ("network_id", r"(ip_address|ip_addr|user_agent|device_id|mac_address)"),
    ("national_id", r"\b(cpf|cnpj|ssn|nif|national_id)\b"),
    ("person_name", r"(^|_)(nome|name|sobrenome|surname)($|_)"),
    ("email", r"(email|e_mail|mail)"),
    ("phone", r"(telefone|phone|celular|mobile|msisdn)"),
    ("birth_date", r"(nascimento|birth|dob)"),
    ("address", r"(endereco|address|logradouro|cep|zipcode|postal)"),
]
EMAIL_PATTERN = r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"
CPF_PATTERN = r"^[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}$"
PHONE_PATTERN = r"^\+?[0-9\s().-]{10,20}$"
SAMPLE_ROWS = 5
STORED_SAMPLE_CHARS = 500


def classify_by_name(name: Column) -> Column:
    return F.coalesce(
        *[F.when(name.rlike("(?i)" + pattern), F.lit(label)) for label, pattern in NAME_PATTERNS]
    )


def is_textual(data_type: T.DataType) -> bool:
    """Whether the value rules apply to a column of this type."""
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


# The value rules are SQL text over an operand (a column or lambda variable name), so that one
# parsed expression covers a column however many rules it needs. Digits are ASCII only.

def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _check_digit(digits: str, length: int) -> str:
    """Mod-11 digit over the first `length` digits, weighted length+1 down to 2."""
    total = (
        f"aggregate(sequence(1, {length}), 0, "
        f"(total, i) -> total + ({length + 2} - i) * (ascii(substr({digits}, i, 1)) - 48))"
    )
    return f"({total} * 10 % 11 % 10)"


def cpf_is_valid(value: str) -> str:
    """True for 11 digits, not all the same, both check digits right; NULL is false."""
    return (
        f"coalesce(exists(array({_digits(value)}), d -> length(d) = 11 AND d != repeat(left(d, 1), 11) "
        f"AND {_check_digit('d', 9)} = ascii(substr(d, 10, 1)) - 48 "
        f"AND {_check_digit('d', 10)} = ascii(substr(d, 11, 1)) - 48), false)"
    )


def cpf_with_check_digits(base: str) -> str:
    """A nine digit string completed with both check digits."""
    ten = f"transform(array({base}), b -> concat(b, {_check_digit('b', 9)}))"
    return f"transform({ten}, t -> concat(t, {_check_digit('t', 10)}))[0]"


def is_email(value: str) -> str:
    return f"({value} RLIKE r'{EMAIL_PATTERN}')"


def has_cpf_shape(value: str) -> str:
    return f"({value} RLIKE r'{CPF_PATTERN}')"


def is_phone(value: str) -> str:
    # CASE, not AND: a conjunction would let common subexpressions strip the digits of every
    # text before looking at its shape.
    return (
        f"CASE WHEN {value} RLIKE r'{PHONE_PATTERN}' THEN length({_digits(value)}) BETWEEN 10 AND 15 "
        f"WHEN {value} IS NOT NULL THEN false END"
    )


def _value_label(email: str, shape: str, verified: str, phone: str) -> str:
    # The shape-only branch can never be reached, since a CPF shape is also a phone
    # shape. It is kept so that the rule order stays readable.
    return (
        f"CASE WHEN {email} THEN 'email' WHEN {shape} AND {verified} THEN 'national_id_verified' "
        f"WHEN {phone} THEN 'phone' WHEN {shape} THEN 'national_id_shape' END"
    )


def classify_value(value: str) -> str:
    """Label of one text value."""
    verified = f"CASE WHEN {has_cpf_shape(value)} THEN {cpf_is_valid(value)} END"
    return _value_label(is_email(value), has_cpf_shape(value), verified, is_phone(value))


def value_rules(value: str) -> dict[str, str]:
    """Each value rule by the label it gives, as a test of one value."""
    return {
        "email": is_email(value),
        "national_id_shape": has_cpf_shape(value),
        "national_id_verified": f"CASE WHEN {has_cpf_shape(value)} THEN {cpf_is_valid(value)} END",
        "phone": is_phone(value),
    }


def classify_values(value: str) -> str:
    """Aggregate label of a text column: a rule counts only if every non-null value obeys it.

    bool_and skips NULLs and is NULL over no values, so an all-null column gets no label.
    CPF arithmetic runs only for values of CPF shape.
    """
    verified = (
        f"CASE WHEN {has_cpf_shape(value)} THEN {cpf_is_valid(value)} WHEN {value} IS NOT NULL THEN false END"
    )
    return _value_label(
        f"bool_and({is_email(value)})",
        f"bool_and({has_cpf_shape(value)})",
        f"bool_and({verified})",
        f"bool_and({is_phone(value)})",
    )


def redact(value: Column) -> Column:
    return F.when(F.length(value) > 2, F.concat(F.left(value, F.lit(2)), F.lit("***"))).when(
        value.isNotNull(), F.lit("***")
    )


def sample_text(samples: Column, is_pii: Column) -> Column:
    """Stored sample string: redacted for flagged columns, NULL spelled out, cut at 500."""
    shown = F.when(is_pii, F.transform(samples, redact)).otherwise(samples)
    return F.left(F.array_join(shown, ", ", "NULL"), F.lit(STORED_SAMPLE_CHARS))
