"""Lists, patterns and constants whose exact content decides results.

They are data of the rules that the engine carries out, written as they are, in
their natural order.
"""

# Words that point to a postal address.
POSTAL = (
    "jr.", "jiron", "av.", "avenida", "cra.", "carrera", "cl.", "calle", "urb.", "urbanizacion", "urbanización", "piso", "of.", "oficina",
    "departamento", "interior", "int.", "mz.", "manzana", "lote", "lt.", "km.", "kilometro", "kilómetro", "n°", "nro.", "nro", "numero", "número",
    "dirección", "direccion", "dir.", "direc.",
)
# Words of institutions' names.
INSTITUTIONS = (
    "universidad", "instituto", "departamento", "facultad", "escuela", "centro", "programa", "grupo", "investigación", "investigacion",
    "corporación", "corporacion", "fundación", "fundacion", "asociación", "asociacion", "convención", "convencion",
)
# Headers of lists of authors and credits.
AUTHOR_HEADERS = (
    "autores", "autor", "autoras", "autora", "investigadores", "investigadoras", "equipo", "consejo directivo", "directores", "directora",
    "director", "participantes", "elaborado por", "preparado por", "coordinadores", "coordinadoras", "coordinador", "facilitadores",
    "facilitador", "facilitadoras", "facilitadora", "diseño y diagramacion", "diseño y diagramación", "diagramacion", "diagramación",
    "nota aclaratoria", "publicado por", "editado por", "copyright", "creditos", "créditos", "fotografia", "fotografía", "foto", "elaboracion",
    "elaboración", "preparacion", "preparación", "revision tecnica", "revisión técnica", "revisado por", "revisor", "revisora", "revisores",
    "asesor", "asesora", "asesores", "asesoras",
)
# Titles of sections.
SECTION_TITLES = (
    "introducción", "introduccion", "resumen", "abstract", "conclusiones", "conclusión", "conclusion", "referencias", "bibliografía",
    "bibliografia", "índice", "indice", "contenido", "tabla de contenido", "anexo", "annex", "anexos", "resumen ejecutivo", "marco teórico",
    "marco teorico", "metodología", "metodologia", "resultados", "discusión", "discusion", "agradecimientos", "glosario", "siglas",
    "abreviaturas", "objetivos", "objetivo general", "objetivos específicos", "objetivos especificos", "antecedentes", "justificación",
    "justificacion", "hipótesis", "hipotesis", "preguntas de investigación", "preguntas de investigacion", "limitaciones", "alcance",
    "marco legal", "marco conceptual",
)
# How editorial notes begin.
EDITORIAL = (
    "titulo:", "título:", "publicado por", "editado por", "nota aclaratoria", "esta permitida la reproduccion",
    "está permitida la reproducción", "todos los derechos reservados",
)
# Patterns of contacts, numbering and noise lines, with Unicode classes and case.
EMAIL = r"(?U)[\w.\-+]+@[\w.\-]+\.\w{2,}"
URL = (
    r"""(?iU)(?:https?|ftp)://[^\s<>"')]+|www\.[^\s<>"')]+|(?<![@\w])[^\s<>"'):/@]+\."""
    r"""(?:com|org|net|edu|gov|pe|co|mx|ar|cl|br|es|int|io|ai|info|biz|coop)[^\s<>"')]*"""
)
PHONE = (
    r"(?U)(?:\+\d{1,3}[\s.\-])?(?:\d{3}[\s.\-]\d{3}[\s.\-]\d{3}|\d{2}[\s.\-]\d{3}[\s.\-]\d{4}|\d{1}[\s.\-]\d{3}[\s.\-]\d{4}"
    r"|\(\d{1,4}\)[\s.\-]?\d{3}[\s.\-]\d{4}|\(\d{3}\)[\s.\-]?\d{3}[\s.\-]\d{3})"
)
PICTURE = r"(?isU)<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->"
ONLY_NUMBER = r"(?U)^\s*\d{1,4}\s*\.?\s*$"
INDEX_ROW = r"(?iU)^\s*\|+.*[IVXivx0-9]+[\.:\|].*\d+\s*\|*\s*$"
LEGAL = r"(?iU)reproduccion|reproducción|derechos reservados|prohibida la reproduccion|prohibida la reproducción"
PHOTO_CREDIT = r"(?iU)©\s*.+\s*/\s*"
ANNEX = r"(?iU)^(anexo|annex)\s+[IVXivx0-9]+"
SECTION_NUMBER = r"(?U)^(?:[IVX]{2,5}\.|\d+(?:\.\d+)*\s*[\.\)\-]|[a-zA-Z]\)\s+)"
ONLY_ITEM = r"(?U)^\s*(?:\d+[\.\)]|[a-zA-Z][\.\)]|[-•◦○▪►])\s*$"
# Abbreviations that don't end a sentence.
ABBREVIATIONS = ("dr.", "dra.", "sr.", "sra.", "srta.", "ing.", "lic.", "etc.", "ej.", "p.", "pp.", "n.º", "n°.")
# Head nouns of generic actors, without accents.
ACTOR_HEADS = (
    "abogada", "abogado", "actor", "agricultor", "agricultora", "autoridad", "cargador", "carretillero", "cauchero", "chambero", "chichiquero",
    "colega", "colono", "comerciante", "companero", "comprador", "comunidad", "contador", "dirigente", "docente", "empresario", "entrevistado",
    "espanol", "facturador", "familiar", "funcionario", "hijo", "hispano", "indigena", "ingeniero", "joyera", "joyero", "machetero", "miembro",
    "minera", "minero", "motorista", "mujer", "nativo", "obrera", "obrero", "padre", "paisano", "persona", "policia", "poblacion", "presidenta",
    "presidente", "propietaria", "propietario", "prostituta", "pueblo", "recolector", "serrano", "sociedad", "talador", "tecnica", "tecnico",
    "titular", "trabajador", "transportista", "tripulante", "varon",
)
# Irregular singulars.
IRREGULAR = {
    "actores": "actor", "autoridades": "autoridad", "comunidades": "comunidad", "hombres": "hombre", "jóvenes": "joven", "mujeres": "mujer",
    "padres": "padre", "personas": "persona", "poblaciones": "población", "presidentes": "presidente",
}
# Words after which nothing is inflected, and words that rule a generic actor out.
INFLECTION_ENDS = ("a", "al", "con", "de", "del", "en", "para", "por", "sin")
ACTOR_BLOCKERS = ("llamado", "llamada")
CONNECTORS = ("o", "que", "u", "y")
# Particles of persons' names, and words that no person's name has.
PARTICLES = ("de", "del", "la", "las", "los", "y")
PERSON_BLOCKERS = (
    "academia", "amazonas", "asociacion", "banco", "comite", "comunidad", "congreso", "corporacion", "direccion", "empresa", "estado", "estados",
    "federacion", "frente", "gobierno", "goremad", "iglesia", "imperio", "inei", "madre", "midagri", "mincul", "minem", "ministerio", "mineria",
    "organizacion", "peru", "policia", "proyecto", "pueblo", "red", "republica", "sa", "sac", "sociedad", "universidad", "virreinato", "eirl",
    "inc", "ltda",
)
# Acceptance of a fuzzy match.
THRESHOLDS = {"CHAR": 93.0, "LOC": 93.0, "INFRA": 96.0, "GOV": 96.0, "PRAC": 96.0}
MARGIN, LEAST_LENGTH = 5.0, 5
MATCH_TYPES = ("exact", "morphology", "person_alias", "stored_alias", "person_name", "fuzzy", "new")
VERSION = "deterministic-v2"
# Dashes and quotes that count as the plain ones.
DASHES = "‐‑‒–—―"
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}
