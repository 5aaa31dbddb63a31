"""Entity types and the recognised words of the text engine."""

# Entity type, marker code, priority, whether leak checks look for it, order when masking questions
ENTITIES = (
    ("schema", "SCH", 90, True, 4),
    ("table", "TBL", 85, True, 1),
    ("view", "VIW", 85, True, 2),
    ("column", "COL", 80, True, 9),
    ("index", "IDX", 85, True, 3),
    ("constraint", "CST", 80, True, 5),
    ("partition", "PRT", 80, True, 6),
    ("alias", "ALS", 75, False, 99),
    ("query_block", "QB", 95, False, 99),
    ("db_link", "DBL", 80, True, 7),
    ("user", "USR", 75, True, 99),
    ("database", "DB", 75, True, 99),
    ("service", "SVC", 75, True, 99),
    ("host", "HST", 75, True, 99),
    ("program", "PRG", 75, True, 99),
    ("module", "MOD", 75, True, 99),
    ("action", "ACT", 75, True, 99),
    ("sql_id", "SQLID", 95, True, 8),
    ("plan_hash", "PHV", 95, False, 99),
    ("execution_id", "EXE", 95, False, 99),
    ("session_id", "SID", 95, False, 99),
    ("object_id", "OID", 75, False, 99),
    ("bind", "BND", 94, False, 99),
    ("string_literal", "STR", 100, False, 99),
    ("number_literal", "NUM", 100, False, 99),
    ("datetime_literal", "DT", 100, False, 99),
    ("comment", "CMT", 100, False, 99),
    ("function", "FUN", 60, False, 99),
    ("identifier", "IDN", 50, False, 99),
    ("fragment", "FRG", 40, False, 99),
)
CODE = {name: code for name, code, *_ in ENTITIES}
PRIORITY = {name: priority for name, _, priority, *_ in ENTITIES}
LEAK_TYPES = tuple(name for name, _, _, leak, _ in ENTITIES if leak)
MASK_ORDER = {name: order for name, *_, order in ENTITIES}
KINDS = ("sql", "xplan", "sql_monitor", "outline", "predicates", "unknown")

# Functions that stay readable when called
FUNCTIONS = frozenset(
    """ABS ADD_MONTHS AVG BITAND CAST CEIL COALESCE COUNT CURRENT_DATE CURRENT_TIMESTAMP DECODE DENSE_RANK EXTRACT FLOOR
    GREATEST JSON_EXISTS JSON_QUERY JSON_TABLE JSON_VALUE LAG LEAD LEAST LISTAGG LOWER MAX MIN MOD MONTHS_BETWEEN NVL NVL2
    ORA_HASH RANK REGEXP_LIKE REGEXP_REPLACE REGEXP_SUBSTR ROUND ROW_NUMBER RTRIM SUBSTR SUM SYS_CONTEXT TO_CHAR TO_DATE
    TO_NUMBER TO_TIMESTAMP TRIM TRUNC UPPER""".split()
)
# Hints that stay readable
HINTS = frozenset(
    """ALL_ROWS APPEND BEGIN_OUTLINE_DATA CARDINALITY CLUSTER DB_VERSION END_OUTLINE_DATA FIRST_ROWS FULL
    GATHER_PLAN_STATISTICS IGNORE_OPTIM_EMBEDDED_HINTS INDEX INDEX_ASC INDEX_DESC INDEX_RS_ASC LEADING MERGE MONITOR NO_MERGE
    NO_PARALLEL NO_UNNEST NLJ_BATCHING OPTIMIZER_FEATURES_ENABLE OPT_PARAM ORDERED OUTLINE OUTLINE_LEAF PARALLEL
    PQ_DISTRIBUTE PQ_FILTER PUSH_PRED RBO_OUTLINE SERIAL SWAP_JOIN_INPUTS UNNEST USE_HASH USE_MERGE USE_NL""".split()
)
HINT_WORDS = HINTS | {"DEFAULT", "FIXED"}
# Pseudo-columns and constants that stay readable
SPECIAL = frozenset("ROWID ROWNUM LEVEL SYSDATE SYSTIMESTAMP NULL TRUE FALSE".split())
# Words of SQL and PL/SQL that name nothing of the user's
KEYWORDS = frozenset(
    """ACCESS ADD ALL ALTER ALWAYS AND ANY AS ASC AT BEGIN BETWEEN BIGINT BINARY BLOB BODY BOTH BULK BY BYTE CALL CASCADE CASE CHAR
    CHECK CLOB CLOSE CLUSTER COLLATE COLUMN COMMENT COMMIT CONNECT CONNECT_BY_ISCYCLE CONNECT_BY_ISLEAF CONNECT_BY_ROOT CONSTRAINT
    CONSTRAINTS CREATE CROSS CURRENT CURSOR CYCLE DATE DAY DEC DECIMAL DECLARE DEFAULT DEFERRABLE DELETE DESC DETERMINISTIC DIRECTORY
    DISABLE DISTINCT DOUBLE DROP ELSE ELSIF ENABLE END ERROR ERRORS ESCAPE EXCEPT EXCEPTION EXCLUDE EXCLUSIVE EXECUTE EXISTS EXIT
    EXPLAIN EXTERNAL FETCH FILTER FINAL FIRST FLOAT FOLLOWING FOR FORALL FOREIGN FORMAT FROM FULL FUNCTION GENERATED GLOBAL GRANT GROUP
    GROUPING HASH HAVING HEAP HOUR IDENTIFIED IDENTITY IF IGNORE IMMEDIATE IN INCLUDING INCREMENT INDEX INITIAL INITIALLY INNER INSERT
    INT INTEGER INTERSECT INTERVAL INTO IS ISOLATION JOIN KEEP KEY LAST LATERAL LEADING LEFT LESS LIKE LIMIT LIST LOCAL LOCK LOG LOGGING
    LONG LOOP MATCHED MATERIALIZED MAXVALUE MEASURES MERGE MINUS MINUTE MINVALUE MODE MODEL MODIFY MONTH NATURAL NCHAR NEXT NO NOCYCLE
    NOLOGGING NOMAXVALUE NOT NOWAIT NULLS NUMBER NUMERIC NVARCHAR2 OF OFFSET ON ONLY OPEN OPTION OR ORDER OTHERS OUT OUTER OVER
    PACKAGE PARALLEL PARTITION PARTITIONS PERCENT PIVOT PLAN PRECEDING PRECISION PRESERVE PRIMARY PRIOR PRIVILEGES PROCEDURE PURGE RAISE
    RANGE RAW REAL RECORD REF REFERENCES REJECT RENAME REPLACE RESPECT RETURN RETURNING REVERSE REVOKE RIGHT ROLLBACK ROLLUP CUBE ROW ROWS
    SAMPLE SAVEPOINT SEARCH SECOND SEED SELECT SEQUENCE SESSION SET SETS SHARE SIBLINGS SIZE SKIP SMALLINT SOME START STATEMENT
    STORAGE SUBPARTITION SYNONYM TABLE TABLESPACE TEMPORARY THAN THEN TIES TIME TIMESTAMP TO TRAILING TRANSACTION TRIGGER TRUNCATE TYPE
    UNBOUNDED UNION UNIQUE UNPIVOT UNTIL UPDATE UPSERT USING VALUES VARCHAR VARCHAR2 VARRAY VIEW WAIT WHEN WHERE WHILE WITH WITHIN WITHOUT
    WORK WRITE XML YEAR ZONE""".split()
)
# Words that leak checks and question masking leave alone
LEAK_ALLOWED = tuple("TABLE INDEX USER SESSION SERVICE PROGRAM MODULE ACTION DATABASE COLUMN VIEW DUAL STATUS NAME TYPE ID TIME ROWS BYTES COST".split())

# Labels of a monitor report's global section whose values are masked, by entity type
GLOBAL_MASKED = {
    "session_id": ("instance id", "session", "session id", "session serial"),
    "sql_id": ("sql id",),
    "execution_id": ("sql execution id", "sql exec id", "dbop execution id"),
    "module": ("module/action",),
    "service": ("service",),
    "program": ("program",),
    "database": ("database", "db name", "db unique name", "container", "pdb name", "con name", "dbid", "database id"),
    "host": ("host", "machine"),
    "user": ("user", "os user"),
    "plan_hash": ("sql plan hash value", "plan hash value", "sql full plan hash value"),
    "identifier": ("dbop name", "client identifier", "client info"),
    "object_id": ("object id", "object#"),
}
# Labels whose values stay
GLOBAL_KEPT = ("status", "execution started", "sql execution start", "first refresh time", "last refresh time", "duration", "fetch calls", "dop", "degree of parallelism", "px servers allocated", "report level")
# Columns of a monitor report's detail tables that are masked, by entity type
COLUMNS_MASKED = {
    "session_id": ("instance", "instance id", "session", "session id", "session serial", "server#"),
    "user": ("user", "username"),
    "host": ("host", "machine"),
    "program": ("process", "program"),
    "module": ("module",),
    "action": ("action",),
    "service": ("service",),
}
# Identity columns of plan tables
PLAN_IDENTITY = {"object_id": ("object id", "object#"), "session_id": ("inst", "instance", "instance id")}
# Phrases of plan notes that stay
SAFE_NOTES = ("dynamic statistics", "statistics feedback", "cardinality feedback", "adaptive plan", "basic plan statistics", "degree of parallelism", "sql profile", "sql plan baseline", "outline", "rule based optimizer")

# Sections of the two reports
PLAN_SECTIONS = ("Query Block Name / Object Alias", "Outline Data", "Predicate Information", "Column Projection Information", "Peeked Binds", "Remote SQL Information", "Note", "Hint Report")
MONITOR_SECTIONS = ("SQL Text", "Global Information", "Global Stats", "SQL Plan Monitoring Details", "Parallel Execution Details", "Activity", "Metrics", "Bind Variables", "Binds")

# Headings of prompts
TYPE_LABELS = {"sql": "SQL", "xplan": "DBMS_XPLAN", "sql_monitor": "SQL MONITOR TEXT", "outline": "OUTLINE DATA", "predicates": "PREDICATES", "unknown": "OTHER MATERIAL"}
PROMPT_MATERIALS = "Материалы ниже псевдонимизированы. Маркеры вида OBF_* обозначают согласованные сущности. Не изменяйте, не сокращайте и не склоняйте эти маркеры в ответе — они будут восстановлены локально."
PROMPT_FOLLOW_UP = "В вопросах ниже используются псевдонимизированные маркеры вида OBF_* из предыдущего контекста диалога. Не изменяйте, не сокращайте и не склоняйте эти маркеры в ответе — они будут восстановлены локально."
PROMPT_QUESTION = "ВОПРОС"


def by_label(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {label: kind for kind, labels in groups.items() for label in labels}
