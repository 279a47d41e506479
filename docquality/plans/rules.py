"""What is known about each type of document: its fields, how they are found, and how they are judged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Types, fields, labels and weights.
TYPES = ("CNH_Frente", "CNH_Verso", "CPF_Frente", "CPF_Verso", "RG_Frente", "RG_Verso")
OTHER = "outros"
OTHER_NAMES = ("outro", "outros", "desconhecida", "desconhecido")
STOP_MARKERS = ("CPF", "CAT", "PERMISSAO", "VALIDADE", "REGISTRO", "ASSINATURA", "NATURALIDADE", "DOC", "LOCAL")
MINIMUM = {
    "CPF_Frente": ("numero_cpf", "nome", "data_nascimento"),
    "CPF_Verso": ("emissao",),
    "CNH_Frente": ("nome", "cpf", "data_nascimento"),
    "CNH_Verso": ("data_emissao",),
    "RG_Frente": ("orgao_emissor",),
    "RG_Verso": ("registro_geral", "nome", "cpf", "data_nascimento"),
}
AUDIT_LABELS = {
    "CPF_Frente": {"numero_cpf": ("NUMERO DE INSCRICAO", "CPF"), "nome": ("NOME",), "data_nascimento": ("NASCIMENTO",)},
    "CPF_Verso": {"emissao": ("EMISSAO",), "site": ("WWW", "CORREIOS")},
    "CNH_Frente": {
        "nome": ("NOME",), "cpf": ("CPF",), "data_nascimento": ("DATA NASCIMENTO", "NASCIMENTO"), "documento_identidade": ("DOC IDENTIDADE", "IDENTIDADE"),
        "filiacao": ("FILIACAO",), "validade": ("VALIDADE",), "primeira_habilitacao": ("1A HABILITACAO", "1 HABILITACAO"), "numero_registro": ("N REGISTRO", "REGISTRO"), "categoria": ("CAT HAB",),
    },
    "CNH_Verso": {"local": ("LOCAL",), "data_emissao": ("DATA EMISSAO", "EMISSAO"), "numero_registro": ("REGISTRO",), "observacoes": ("OBSERVACOES",)},
    "RG_Frente": {"orgao_emissor": ("SECRETARIA", "INSTITUTO"), "observacoes": ("NAO DOADOR", "DOADOR")},
    "RG_Verso": {
        "registro_geral": ("REGISTRO GERAL", "REGISTRO"), "data_expedicao": ("DATA EXPEDICAO", "EXPEDICAO"), "nome": ("NOME",), "filiacao": ("FILIACAO",),
        "naturalidade": ("NATURALIDADE",), "doc_origem": ("DOC ORIGEM",), "cpf": ("CPF",), "data_nascimento": ("DATA DE NASCIMENTO", "NASCIMENTO"),
    },
}
WEIGHTS = {
    "field_extracted": 0.22, "came_after_expected_label": 0.16, "distance_to_label": 0.12, "regex_full_match": 0.18, "format_valid": 0.16,
    "no_candidate_conflict": 0.08, "minimum_expected_field_found": 0.04, "cpf_has_11_digits": 0.06, "cpf_check_digits_valid": 0.06, "date_plausible": 0.06,
}
SCENARIOS = ("phone_tilt_color_background", "perspective_shadow", "low_light_blur", "noise_jpeg", "strong_skew_color_background", "multi_degradation")
# Ranges of colours (three channels each), and the transforms of each scenario with their ranges.
PALETTES = (
    ((120, 185), (93, 140), (32, 74)),
    ((86, 160), (132, 210), (120, 190)),
    ((148, 220), (76, 150), (108, 185)),
    ((180, 245), (175, 235), (170, 235)),
    ((95, 165), (95, 170), (80, 150)),
)
TRANSFORMS = {
    "phone_tilt_color_background": (
        ("affine", {"rotate": (-10, 10), "scale": (0.90, 1.03), "translate": (-0.055, 0.055), "shear": (-1.5, 1.5)}, 1.0),
        ("brightness_contrast", {"brightness": (-0.18, 0.18), "contrast": (-0.18, 0.22)}, 1.0),
        ("hue_saturation", {"hue": (-4, 4), "saturation": (-16, 16), "value": (-8, 8)}, 0.65),
        ("shadow", {"shadows": (1, 2), "intensity": (0.30, 0.58)}, 0.8),
    ),
    "perspective_shadow": (
        ("perspective", {"scale": (0.035, 0.10)}, 1.0),
        ("affine", {"rotate": (-4, 4), "scale": (0.92, 1.02), "translate": (-0.035, 0.035), "shear": (-1.5, 1.5)}, 1.0),
        ("shadow", {"shadows": (1, 2), "intensity": (0.38, 0.66)}, 1.0),
        ("brightness_contrast", {"brightness": (-0.14, 0.08), "contrast": (-0.10, 0.28)}, 1.0),
    ),
    "low_light_blur": (
        ("affine", {"rotate": (-7, 7), "scale": (0.91, 1.01), "translate": (-0.04, 0.04), "shear": (-2, 2)}, 1.0),
        ("brightness_contrast", {"brightness": (-0.42, -0.18), "contrast": (-0.28, 0.05)}, 1.0),
        ("blur", {"size": (3, 7)}, 1.0),
        ("shadow", {"shadows": (1, 2), "intensity": (0.35, 0.68)}, 0.85),
    ),
    "noise_jpeg": (
        ("affine", {"rotate": (-6, 6), "scale": (0.92, 1.04), "translate": (-0.045, 0.045), "shear": (-1.5, 1.5)}, 1.0),
        ("noise", {"std": (0.015, 0.075)}, 1.0),
        ("brightness_contrast", {"brightness": (-0.24, 0.16), "contrast": (-0.22, 0.20)}, 1.0),
        ("compression", {"quality": (48, 78)}, 1.0),
    ),
    "strong_skew_color_background": (
        ("perspective", {"scale": (0.07, 0.14)}, 1.0),
        ("affine", {"rotate": (-12, 12), "scale": (0.88, 1.00), "translate": (-0.065, 0.065), "shear": (-4, 4)}, 1.0),
        ("brightness_contrast", {"brightness": (-0.22, 0.22), "contrast": (-0.24, 0.34)}, 1.0),
        ("hue_saturation", {"hue": (-6, 6), "saturation": (-22, 22), "value": (-12, 12)}, 0.75),
    ),
    "multi_degradation": (
        ("perspective", {"scale": (0.04, 0.11)}, 1.0),
        ("affine", {"rotate": (-9, 9), "scale": (0.89, 1.02), "translate": (-0.055, 0.055), "shear": (-2.5, 2.5)}, 1.0),
        ("shadow", {"shadows": (1, 3), "intensity": (0.32, 0.70)}, 0.9),
        ("brightness_contrast", {"brightness": (-0.32, 0.12), "contrast": (-0.30, 0.30)}, 1.0),
        ("blur", {"size": (3, 5)}, 0.6),
        ("noise", {"std": (0.012, 0.055)}, 0.75),
        ("compression", {"quality": (52, 86)}, 1.0),
    ),
}
ACCEPT_FIELD = ACCEPT_DOCUMENT = GOOD_TEXT = 0.8
#: The field name under which the whole text is compared.
WHOLE_TEXT = "__texto_completo__"


@dataclass(frozen=True)
class Rule:
    """How a field is found: `value` or `date` near a label, `names` of parents, or the first `pattern` in the text."""

    field: str
    method: str
    labels: tuple[str, ...] = ()
    pattern: str = ""


# The fields of each type, in order, with the labels they are found by.
RULES = {
    "CPF_Frente": (Rule("numero_cpf", "cpf"), Rule("nome", "value", ("NOME",)), Rule("data_nascimento", "date", ("NASCIMENTO",))),
    "CPF_Verso": (Rule("emissao", "value", ("EMISSAO",)), Rule("site", "pattern", pattern="SITE")),
    "CNH_Frente": (
        Rule("nome", "value", ("NOME",)),
        Rule("cpf", "cpf"),
        Rule("data_nascimento", "date", ("DATA NASCIMENTO", "NASCIMENTO")),
        Rule("documento_identidade", "value", ("DOC IDENTIDADE", "IDENTIDADE")),
        Rule("filiacao", "names"),
        Rule("validade", "date", ("VALIDADE",)),
        Rule("primeira_habilitacao", "date", ("1A HABILITACAO", "1ª HABILITACAO")),
        Rule("numero_registro", "value", ("N REGISTRO", "REGISTRO")),
        Rule("categoria", "value", ("CAT HAB", "CAT. HAB")),
    ),
    "CNH_Verso": (
        Rule("local", "value", ("LOCAL",)),
        Rule("data_emissao", "date", ("DATA EMISSAO", "EMISSAO")),
        Rule("numero_registro", "pattern", pattern="LONG_DIGITS"),
        Rule("observacoes", "value", ("OBSERVACOES",)),
    ),
    "RG_Frente": (Rule("orgao_emissor", "value", ("SECRETARIA", "INSTITUTO")), Rule("observacoes", "value", ("NAO DOADOR", "DOADOR"))),
    "RG_Verso": (
        Rule("registro_geral", "value", ("REGISTRO GERAL", "REGISTRO"), "RG"),
        Rule("data_expedicao", "date", ("DATA EXPEDICAO", "EXPEDICAO")),
        Rule("nome", "value", ("NOME",)),
        Rule("filiacao", "names"),
        Rule("naturalidade", "value", ("NATURALIDADE",)),
        Rule("doc_origem", "value", ("DOC ORIGEM",)),
        Rule("cpf", "cpf"),
        Rule("data_nascimento", "date", ("DATA DE NASCIMENTO", "NASCIMENTO")),
    ),
}


def document_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TYPES], "document_type string")


def expected_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, f) for t, fields in MINIMUM.items() for i, f in enumerate(fields)], "document_type string, ordinal int, field_name string")


def audit_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f, list(labels)) for t, fields in AUDIT_LABELS.items() for f, labels in fields.items()], "document_type string, field_name string, labels array<string>")


def scenario_parameters(spark: SparkSession) -> DataFrame:
    """(scenario, step, transform, parameter, low, high, chance) of every range."""
    rows = [(s, i, t, p, float(lo), float(hi), chance) for s, steps in TRANSFORMS.items() for i, (t, ranges, chance) in enumerate(steps) for p, (lo, hi) in ranges.items()]
    return spark.createDataFrame(rows, "scenario string, step int, transform string, parameter string, low double, high double, chance double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SCENARIOS)), "idx int, scenario string")
