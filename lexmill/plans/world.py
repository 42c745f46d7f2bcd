"""Cases, documents, mails and usage made of the driver's tables, so that operators meet the columns they are written for.

One SQL text per table, in what Spark and DuckDB share: queries read it as a DataFrame, their SQL as a common table
expression. Values are spread by the remainders of keys, with the gaps, variants and errors that real files have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexmill.plans.catalogue import ORACLES, QUERIES, Tables

_PAD = "lpad(cast({0} as string), {1}, '0')"


def _pick(key: str, *values: str) -> str:
    """SQL: one of the values (SQL texts) by the remainder of ``key``."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _words(key: str, *values: str | None) -> str:
    return _pick(key, *("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values))


_DAY = f"{_PAD.format('day(o_orderdate)', 2)} || '/' || {_PAD.format('month(o_orderdate)', 2)} || '/' || cast(year(o_orderdate) + 25 as string)"
_YEAR = "cast(year(o_orderdate) + 25 as string)"
_SEQ = _PAD.format("o_orderkey % 9000", 5)
_COURT = f"'68' || {_PAD.format('c_nationkey', 3)} || '40' || {_PAD.format('o_orderkey % 3', 2)} || {_PAD.format('o_custkey % 7', 3)}"
_ID23 = f"{_COURT} || {_YEAR} || {_SEQ} || '00'"
_FIRST = _words("o_custkey", "María", "JUAN", "Pedro", " ana ", "Luz", "Íñigo", "José", "rosa")
_LAST = _words("cast(floor(o_custkey / 8) as bigint)", "Pérez Díaz", "gómez  Ruiz", "Peña", "Núñez Mora", "Rojas", "Ortiz Vega", "Acuña")
_NAME = f"{_FIRST} || ' ' || {_LAST}"

CASES = f"""
select o_orderkey as id, o_custkey as person,
  case when o_orderkey % 29 = 0 then '' when o_orderkey % 31 = 0 then 'None' when o_orderkey % 37 = 0 then null
       when o_orderkey % 41 = 0 then '[PENDIENTE REVISION] ' || {_SEQ} when o_orderkey % 43 = 0 then '[PENDIENTE IDENTIFICACION]'
       when o_orderkey % 47 = 0 then '20222-' || {_SEQ} || ' X' when o_orderkey % 53 = 0 then {_YEAR} || '-' || cast(10000 + o_orderkey % 70000 as string) || ' FOREST'
       when o_orderkey % 59 = 0 then 'CORREO ' || {_NAME} else {_YEAR} || '-' || {_SEQ} || ' ' || upper({_NAME}) end as folder,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then '' when o_orderkey % 17 = 0 then left({_ID23}, 15)
       when o_orderkey % 19 = 0 then {_COURT} || '-' || {_YEAR} || '-' || {_SEQ} || '-00' else {_ID23} end as court_id,
  case when o_orderkey % 5 = 0 then null when o_orderkey % 23 = 0 then '3634740' else '2026' || {_PAD.format('o_orderkey % 5000', 7)} end as filing,
  case when o_orderkey % 27 = 0 then '' when o_orderkey % 33 = 0 then null when o_orderkey % 14 = 0 then 'Personería municipal de ' || n_name else {_NAME} end as claimant,
  {_words("o_orderkey", "ALCALDIA - GOBERNACION", "Secretaría de Educación", None, "NUEVA EPS - GOBERNACION - ICBF", "")} as defendants,
  {_words("o_custkey", "Ministerio", None, "Procuraduría - Ministerio", "")} as linked,
  {_words("o_orderkey", "SALUD - VIDA DIGNA", "Derecho de petición", "EDUCACIÓN - igualdad", "debido proceso - TRABAJO", None, "", "MINIMO VITAL - SALUD", "Vida Digna - OTRO")} as rights,
  {_words("o_custkey", " JUZGADO 1 CIVIL MUNICIPAL ", "Juzgado 2 Penal del Circuito", "TRIBUNAL SUPERIOR", None, "Juzgado Promiscuo Municipal", "")} as court,
  {_words("o_custkey", "Bucaramanga, Santander", "BOGOTA", "giron", "San Gil", None, "Gambita, Colombia", "floridablanca", "Bogota D.C.", "")} as city,
  case when o_orderkey % 21 = 0 then 'sin fecha' when o_orderkey % 26 = 0 then null else {_DAY} end as admitted,
  {_pick("o_orderkey", "'ACTIVO'", "'INACTIVO'", "'ACTIVO'", "'activo'", "null")} as state,
  {_words("o_custkey", "juan deigo cruz lizcano CPS 12", "ANA MARIA DEL PILAR DE LA CRUZ ROJAS", "Pedro Gil contrato 9", None, "luis o'neil", "", "Carlos Mesa cc. 123")} as lawyer,
  {_words("o_orderkey", "CONCEDE", "NIEGA", "CONCEDE PARCIALMENTE", "IMPROCEDENTE", None, "", "Concede y niega", "desistimiento")} as ruling1,
  case when o_orderkey % 9 = 0 then null else {_DAY} end as ruling1_date,
  {_words("o_orderkey", "SI", "NO", "si", None, "", "SI")} as appeal,
  {_words("o_orderkey", "ACCIONADO", "ACCIONANTE", None)} as appellant,
  {_words("cast(floor(o_orderkey / 3) as bigint)", None, "CONFIRMA", "REVOCA", "", "MODIFICA", None, None, "confirma")} as ruling2,
  {_words("o_orderkey", None, "15/03/2024", "2024-04-02", "31/02/2024", "")} as ruling2_date,
  {_words("o_custkey", "SI", "NO", None, "NO")} as incident,
  {_words("o_orderkey", None, "10/01/2024", "5/6/2024", "")} as incident_date,
  {_words("cast(floor(o_orderkey / 2) as bigint)", None, "", "SANCIONA con multa", "pendiente", "Consulta", "NULIDAD", "Cumplida la orden", "ARCHIVA", "otra")} as incident_decision,
  {_words("o_orderkey", None, "12/02/2024", "", "20/01/2023", "1/2/2025")} as answered,
  {_words("o_custkey", "  secretaría de salud ", "DESPACHO", None, "oficina jurídica del departamento de santander y anexos", "")} as office,
  {_words("o_orderkey", "Tutela por cita médica", "Pago de nómina a docentes", None, "Transporte escolar", "Cupo escolar y docentes")} as subject,
  {_pick("o_orderkey", "null", "'Se dio cumplimiento'", "'CC ' || cast(60000000 + o_custkey as string)", "'ABRE INCIDENTE de desacato'", "''", "'Remite a consulta'", "'multa'", "'no procede'")} as notes,
  {_words("o_orderkey", "COMPLETO", "REVISION", "PENDIENTE", None, "COMPLETO", "DUPLICATE_MERGED", "EXTRAYENDO")} as status,
  {_words("o_orderkey", "TUTELA", "TUTELA", "INCIDENTE", None)} as kind,
  o_orderdate + interval '9132' day as created
from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey"""

_FILE = _pick(
    "part",
    "'Email_20240105_traslado_' || cast(part as string) || '.md'", "'gmail - notificacion.pdf'", "'Auto Admisorio ' || cast(part as string) || '.pdf'", "'SENTENCIA de tutela.pdf'",
    "'Impugnación.pdf'", "'Incidente desacato ' || cast(case_id as string) || '.pdf'", "'Respuesta tutela.docx'", "'contestacion incidente.docx'", "'RESPUESTA impugnacion.DOCX'",
    "'Cumplimiento fallo.docx'", "'con forest 2026.docx'", "'Solicitud insumos.docx'", "'memorial.doc'", "'Oficio 12.docx'", "'otro.docx'", "'foto.PNG'", "'emailviejo.pdf'", "'anexo.pdf'", "'1_escrito.pdf'", "'02. pruebas.pdf'",
)
_OTHER23 = f"'68' || {_PAD.format('part % 900', 3)} || '4003001' || '2024' || {_PAD.format('part', 5)} || '00'"
_TEXT = _pick(
    "part",
    "null", "'corto'", f"'Radicado No. ' || {_OTHER23} || ' accionante Pedro Gil. RESUELVE: PRIMERO: TUTELAR y CONCEDE el amparo. Bucaramanga, 15 de marzo de 2024'",
    "'Correo rad: 2024-00' || cast(100 + part % 800 as string) || ' tel 3101234567 y 3159876543, cédula 63.' || cast(100 + part % 900 as string) || '.123, ana@x.gov.co'",
    "'FALLO: RESUELVE NIEGA por improcedente. SEGUNDO: notifíquese. Dado el 5 de enero de 2023'", f"'Proceso 68-001-40-03-' || {_PAD.format('part % 900', 3)} || '-2024-' || {_PAD.format('part', 5)} || '-00 T-00' || cast(part % 900 as string) || '/2024'",
    "'Diagnóstico E11 y C50. Art. 86 y sentencia T-760 de 2008'", "'radicado 20260012345 FOREST ' || cast(20260000000 + part as string)",
)

_N = lambda first, width: f"'{first}' || {_PAD.format('part', width)}"
#: What follows the text, by another remainder, so that any two meet: numbers, names and formulas of letters, and long passages.
_TAIL = _pick(
    "part",
    "''", f"' Con número de radicado ' || {_N('2026', 7)} || ' se recibió el 7/3/2024.'", "' ACCIONANTE: PARTE ALFA BETA CONTRA LA ALCALDIA'", "' Demandante: Parte Gama Delta en calidad de agente'",
    "' promovida por el señor PARTE EPSILON ZETA contra la EPS'", "' Personero Municipal de Guavatá, Santander'", "chr(10) || 'Proyectó: Letrado Uno Dos' || chr(10) || 'Oficina Jurídica'",
    f"' identificado con C.C. ' || {_N('10', 8)} || ' y NIT 890201235-6, folios: 1234567'", f"' Tutela en Línea con número ' || {_N('36', 5)}", "' ACTA DE REPARTO CIVIL No. ' || cast(part as string)",
    "' Expediente No. 160-' || cast(10 + part % 80 as string)", f"' Registro Civil No. ' || {_N('1130', 6)} || ' del menor'", f"' Resolución No. ' || {_N('22', 6)} || ' y cédula No. ' || {_N('91', 6)} || ' de 2024. Cel: 312' || {_PAD.format('part', 7)}",
    f"' Tercero: ' || {_N('497', 5)} || ' PARTE ETA THETA, cédula 1.' || {_PAD.format('part', 9)}", "' de la parte en el proceso, que el despacho tendrá por surtido' || repeat(' conforme a lo dicho por la parte y probado en el expediente', 40)",
    "' Diríjase a persona' || cast(part % 7 as string) || '@entidad.gov.co o a otra@escuela.edu.co y a la calle 45 No. 12-30'", f"' JUZGADO SEGUNDO CIVIL MUNICIPAL DE BUCARAMANGA radicado y enviado ' || {_N('2025', 7)}",
)

DOCS = f"""
select case_id * 10 + line as id, case_id, {_FILE} as filename, {_TEXT} || {_TAIL} as text, cast(part % 50 as string) || '-' || cast(supp % 3 as string) as file_hash,
  case when part % 4 = 0 then cast(supp as bigint) end as mail_id, {_words("part", "OK", "SOSPECHOSO", None, "NO_PERTENECE", "REVISAR", "OK")} as verified, cast(part as bigint) as part
from (select l_orderkey as case_id, l_linenumber as line, min(l_partkey) as part, min(l_suppkey) as supp from {{lineitem}} group by l_orderkey, l_linenumber) x"""

MAILS = f"""
select event_id as id, '<' || cast(event_id % 4000 as string) || '@corte>' as message_id,
  {_pick("event_id", "'NOTIFICA AUTO ADMISORIIO TUTELA'", "'Fallo de primera instancia rad 2024-' || cast(user_id as string)", "'TRASLADO incidente DESACTO'", "'Segunda instancia: SENTECIA'",
         "'RV: requerimiento previo'", "'Impugna tutela'", "'Alerta de seguridad'", "null", "'Tutlea nueva'", "'NOTIFICAICON: TUTLEA 2024-00' || cast(100 + user_id as string)", "'Correo enviado'", "'saludo'")} as subject,
  {_words("user_id", "Juzgado <j01@cendoj.gov.co>", "noreply@google.com", None, "Ana <ana@x.com>", "Tribunal <t@cendoj.gov.co>")} as sender,
  value, ts as received, case when event_id % 3 = 0 then null else user_id * 7 + event_id % 5 end as case_id,
  {_words("event_id", "PROCESADO", "IGNORADO", "PENDIENTE", "ignorado", None)} as status
from {{events}}"""

USAGE = f"""
select event_id as id, ts as used, {_words("user_id", "deepseek", "openai", "anthropic")} as provider, {_words("event_id", "chat", "reasoner", "mini", "unknown")} as model,
  event_id * 37 % 5000 as tokens_in, event_id * 11 % 900 as tokens_out, case when event_id % 6 = 0 then 'bad' when event_id % 7 = 0 then null else cast(event_id % 90 as string) end as cost,
  case when event_id % 4 = 0 then null else user_id end as case_id, event_id * 13 % 4000 as ms,
  {_words("event_id", None, None, None, "429 too many", None, "rate exceeded", "timeout", None, None, None, None)} as error
from {{events}}"""

REQUESTS = f"""
select s_suppkey as key,
  case s_suppkey % 7 when 0 then {_ID23} when 1 then '68' || {_PAD.format('c_nationkey', 3)} || '990199' || right({_ID23}, 12) when 4 then {_COURT} || '2019' || '00001' || '00' else null end as court_id,
  case when s_suppkey % 7 in (4, 5, 6) or s_suppkey % 3 = 0 then {_YEAR} || '-' || {_PAD.format('o_orderkey % 9000', 5)} end as short,
  case when s_suppkey % 7 = 3 then '2026' || {_PAD.format('o_orderkey % 5000', 7)} end as filing,
  case when s_suppkey % 7 = 2 then cast(60000000 + o_custkey as string) end as person,
  case when s_suppkey % 7 = 5 then 'Personera del ' || n_name when s_suppkey % 2 = 0 then {_NAME} else 'x' end as claimant
from {{supplier}} join {{orders}} on o_orderkey = s_suppkey * 8 + 2 join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey"""

TABLES = {"requests": (REQUESTS, ("supplier", "orders", "customer", "nation")), "cases": (CASES, ("orders", "customer", "nation")), "docs": (DOCS, ("lineitem",)), "mails": (MAILS, ("events",)), "usage": (USAGE, ("events",))}


class World(Tables):
    """The driver's tables and, by the names of ``TABLES``, those made of them."""

    @property
    def parts(self) -> int:
        """Into how many tasks the documents are dealt by case; what is dealt so as well meets them without a shuffle of their texts."""
        return min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            return super().__getattr__(name)
        text, needs = TABLES[name]
        given = {n: getattr(self, n) for n in needs}
        if name == "docs":
            # dealt out by case once, so neither the documents nor what is done by case needs another shuffle; the number is given, as texts are made behind
            # this shuffle of four numbers a row, by whose size the tasks would be few and large
            given["lineitem"] = given["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(self.parts, "l_orderkey")
        return self.spark.sql(text, **given)


def case_query(sql: str | None = None):
    """As ``catalogue.query``, on a ``World``; the SQL may name its tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if sql is not None:
            used = [n for n in TABLES if n in sql]
            made = ", ".join(f"{n} as ({TABLES[n][0].format(**{x: x for x in TABLES[n][1]})})" for n in used)
            rest = sql.lstrip()
            ORACLES[f.__name__] = f"with {made}, {rest[5:]}" if rest.startswith("with ") else f"with {made} {rest}"
        return f

    return register
