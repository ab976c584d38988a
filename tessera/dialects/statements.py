"""The grammars of statements that aren't queries, as overlays: a dialect has its base's rules, replaced or with more ways."""

GRAMMARS: dict[str, str] = {}

GRAMMARS["ansi"] = r'''
_statement = merge | insert | _transaction | drop_table | drop_view | create_user | drop_user | truncate | access | create_table
  | create_role | drop_role | alter_table | create_schema | set_schema | drop_schema | drop_type | create_database
  | drop_database | create_index | drop_index | create_view | delete | update | create_cast | drop_cast | create_function
  | drop_function | create_model | drop_model | describe | use | explain | create_sequence | alter_sequence | drop_sequence
  | create_trigger | drop_trigger | set_statement | comment_on | call
_if_exists = IF EXISTS
_if_not_exists = IF NOT EXISTS
_cascade = CASCADE | RESTRICT | CASCADE CONSTRAINTS
_or_replace = OR REPLACE
_names = <name % ",">
alias = AS? !_after_alias name
_after_alias = SET | USING | WHEN | ON | WHERE | VALUES | DEFAULT | FROM | RETURNING | OUTPUT | PARTITION | OVERRIDING
where = WHERE expr
returning = RETURNING (expr alias?) % ","

insert = INSERT (OVERWRITE | INTO) TABLE? object _names? _insert_source returning? | INSERT object _names? _insert_source returning?
_insert_source = values | query | DEFAULT VALUES
values = VALUES (<_row_value % ","> | expr) % ","
_row_value = DEFAULT | expr
update = UPDATE object alias? SET assignment % "," (FROM _update_from)? (WHERE CURRENT OF name | where)? returning?
_update_from = ..( WHERE | RETURNING ) | ...
assignment = (object | _names) ("[" ..( "]" ) "]")* "=" (DEFAULT | expr)
delete = DELETE FROM object alias? (USING ..( WHERE ))? where? returning? | DELETE FROM object alias? USING ...
truncate = TRUNCATE TABLE? object % "," _truncate_how?
_truncate_how = (RESTART | CONTINUE) IDENTITY _cascade? | _cascade
merge = MERGE INTO? object alias? USING merge_source ON expr merge_match+ returning?
merge_source = (<query> | object) alias?
merge_match = WHEN NOT? MATCHED (BY (SOURCE | TARGET))? (AND expr)? THEN _merge_action
_merge_action = merge_update | merge_delete | merge_insert | DO NOTHING
merge_update = UPDATE SET (assignment % "," | "*") where?
merge_delete = DELETE where?
merge_insert = INSERT (_names? values | "*" | ROW) where?

_transaction = transaction
transaction = (START TRANSACTION | BEGIN | COMMIT | ROLLBACK | END | SAVEPOINT name | RELEASE SAVEPOINT? name) (WORK | TRANSACTION | TRAN)? _transaction_more?
_transaction_more = TO SAVEPOINT? name | AND NO? CHAIN | (ISOLATION LEVEL word word? | READ (ONLY | WRITE)) % ","

create_table = CREATE _or_replace? _table_kind? TABLE _if_not_exists? object _table_body table_option*
_table_kind = TEMPORARY | TEMP | (GLOBAL | LOCAL) (TEMPORARY | TEMP) | EXTERNAL | TRANSIENT | UNLOGGED | VOLATILE
_table_body = <table_element %? ","> (AS? query)? | AS TABLE object | LIKE object | table_option* AS (query | values) | <query> | _names table_option* AS query
table_element = table_constraint | column_definition | LIKE object ((INCLUDING | EXCLUDING) word)*
column_definition = name type column_constraint*
column_constraint = (CONSTRAINT name)? _column_constraint
_column_constraint = NOT NULL | NULL | DEFAULT value | PRIMARY KEY | UNIQUE KEY? | CHECK <expr> | references | COMMENT string
  | GENERATED (ALWAYS | BY DEFAULT) AS IDENTITY <...>? | GENERATED (ALWAYS | BY DEFAULT) AS <expr> (STORED | VIRTUAL)? | AUTO_INCREMENT | COLLATE object | _deferral
references = REFERENCES object _names? (ON (DELETE | UPDATE) _on_change | MATCH word)*
_on_change = CASCADE | RESTRICT | NO ACTION | SET NULL | SET DEFAULT
_deferral = NOT? DEFERRABLE | INITIALLY (DEFERRED | IMMEDIATE)
table_constraint = (CONSTRAINT name)? (PRIMARY KEY _key_columns | UNIQUE (KEY | INDEX)? name? _key_columns | FOREIGN KEY _names references | CHECK <expr>) _deferral*
_key_columns = <(name (ASC | DESC)?) % ",">
table_option = COMMENT "="? string | ON COMMIT (PRESERVE | DELETE) ROWS? | ON COMMIT DROP

alter_table = ALTER TABLE _if_exists? object alter_action % ","
alter_action = ALTER COLUMN _if_exists? name (SET OPTIONS <...> | DROP NOT NULL | DROP DEFAULT | SET DEFAULT value | SET DATA TYPE type) | SET OPTIONS <...> | ADD (COLUMN? _if_not_exists? column_definition _position? | table_constraint) | DROP COLUMN? _if_exists? name _cascade? | DROP CONSTRAINT _if_exists? name _cascade? | DROP PRIMARY KEY
  | ALTER COLUMN? name (TYPE type | SET DATA TYPE type | SET DEFAULT expr | DROP DEFAULT | (SET | DROP) NOT NULL) | MODIFY COLUMN? column_definition _position? | CHANGE COLUMN? name column_definition
  | RENAME (TO | AS)? object | RENAME COLUMN _if_exists? name TO name | RENAME CONSTRAINT name TO name | SET SCHEMA name | OWNER TO name
_position = FIRST | AFTER name
drop_table = DROP (EXTERNAL | TEMPORARY)? TABLE _if_exists? object % "," (_cascade | CASCADE CONSTRAINTS | PURGE)*

create_view = CREATE _or_replace? (TEMPORARY | TEMP)? VIEW _if_not_exists? object _names? AS query (WITH NO SCHEMA BINDING | WITH (CASCADED | LOCAL)? CHECK OPTION | WITH NO? DATA)?
drop_view = DROP MATERIALIZED? VIEW _if_exists? object % "," _cascade?
create_index = CREATE UNIQUE? INDEX _if_not_exists? object? ON object (USING name)? <(_index_item (ASC | DESC)? (NULLS (FIRST | LAST))?) % ","> where?
_index_item = object | expr
drop_index = DROP INDEX _if_exists? object % "," (ON object)? _cascade?
create_schema = CREATE SCHEMA _if_not_exists? object (AUTHORIZATION name)?
set_schema = SET CURRENT? SCHEMA "="? (object | string)
drop_schema = DROP FORCE? SCHEMA _if_exists? object % "," _cascade?
create_database = CREATE DATABASE _if_not_exists? object
drop_database = DROP DATABASE _if_exists? object (WITH? <...> | _cascade | SYNC | ON CLUSTER (name | string))*
drop_type = DROP TYPE _if_exists? object % "," _cascade?
create_role = CREATE ROLE _if_not_exists? name (AUTHORIZATION name)?
drop_role = DROP ROLE _if_exists? name % ","
create_user = CREATE USER _if_not_exists? (name | string) (IDENTIFIED BY string | WITH? PASSWORD string)?
drop_user = DROP USER _if_exists? (name | string) % "," _cascade?
access = GRANT _grant ON _grant_object TO grantee % "," (WITH (GRANT | ADMIN) (OPTION | TRUE | FALSE))? | GRANT ROLE? object % "," TO grantee % "," (WITH (GRANT | ADMIN) (OPTION | TRUE | FALSE))?
  | REVOKE (GRANT OPTION FOR)? _grant ON _grant_object FROM grantee % "," _cascade? | REVOKE object % "," FROM grantee % "," _cascade?
_grant = ALL PRIVILEGES? | privilege % ","
privilege = (SELECT | INSERT | UPDATE | DELETE | TRUNCATE | REFERENCES | TRIGGER | USAGE | EXECUTE | CREATE (TABLE | VIEW | SCHEMA | FUNCTION)? | CONNECT | TEMPORARY | TEMP | ALTER | DROP | INDEX | OWNERSHIP | MODIFY | MONITOR | OPERATE | ALL PRIVILEGES?) _names?
_grant_object = (DOMAIN | TYPE | LANGUAGE | LARGE OBJECT | FOREIGN SERVER | INTEGRATION | STAGE | TASK | STREAM | PIPE | CATALOG | VOLUME | TABLE | VIEW | SCHEMA | DATABASE | SEQUENCE | FUNCTION | PROCEDURE | ROLE | WAREHOUSE | ALL (TABLES | SEQUENCES | FUNCTIONS) IN SCHEMA | FUTURE word IN (SCHEMA | DATABASE))? (object | "*" ("." "*")? | object "." "*" | object "*") % "," <...>?
grantee = (ROLE | USER | GROUP | SHARE)? (PUBLIC | name | string)
create_cast = CREATE CAST <type AS type> WITH (SPECIFIC | INSTANCE | STATIC)? ((FUNCTION | ROUTINE | PROCEDURE | METHOD) object <...>? | INOUT) (FOR object)? (AS (ASSIGNMENT | IMPLICIT))? | CREATE CAST <type AS type> WITHOUT FUNCTION (AS (ASSIGNMENT | IMPLICIT))?
drop_cast = DROP CAST _if_exists? <type AS type> _cascade?
create_function = CREATE _or_replace? (TEMPORARY | TEMP)? FUNCTION _if_not_exists? object <function_parameter % ","> (RETURNS type)? function_part+ | CREATE _or_replace? (TEMPORARY | TEMP)? FUNCTION _if_not_exists? object <> (RETURNS type)? function_part+
function_parameter = (IN | OUT | INOUT)? name type (DEFAULT value | "=" value)? | type
function_part = LANGUAGE (name | string) | IMMUTABLE | STABLE | VOLATILE | STRICT | NOT? DETERMINISTIC | COMMENT string | AS string | RETURN expr | AS <expr>
drop_function = DROP FUNCTION _if_exists? (object <...>?) % "," _cascade?
create_model = CREATE _or_replace? MODEL _if_not_exists? object (OPTIONS <...>)? AS? query
drop_model = DROP MODEL _if_exists? object
describe = (DESCRIBE | DESC) word object | (DESCRIBE | DESC) object | (DESCRIBE | DESC) query
use = USE word object | USE object
explain = EXPLAIN _explain_how* (query | _statement)
_explain_how = ANALYZE | ANALYSE | VERBOSE | FORMATTED | EXTENDED | COST | CODEGEN | PLAN | FOR | <...>
create_sequence = CREATE _or_replace? (TEMPORARY | TEMP)? SEQUENCE _if_not_exists? object (AS type)? sequence_option*
sequence_option = INCREMENT BY? "="? value | START WITH? "="? value | MINVALUE value | NO MINVALUE | MAXVALUE value | NO MAXVALUE | NO? CYCLE | NOCYCLE | CACHE value | NO CACHE | NOCACHE | NO? ORDER | NOORDER | OWNED BY object | RESTART (WITH? value)? | COMMENT "="? string | WITH
alter_sequence = ALTER SEQUENCE _if_exists? object (SET? sequence_option+ | RENAME TO object | SET SCHEMA name)
drop_sequence = DROP SEQUENCE _if_exists? object % "," _cascade?
create_trigger = CREATE _or_replace? TRIGGER object (BEFORE | AFTER | INSTEAD OF) trigger_event (OR trigger_event)* ON object (FROM object)? _deferral* (REFERENCING ((OLD | NEW) (TABLE | ROW)? AS? name)+)? (FOR EACH? (ROW | STATEMENT))? (WHEN <expr>)? trigger_body
trigger_event = INSERT | DELETE | TRUNCATE | UPDATE (OF name % ",")?
trigger_body = EXECUTE (FUNCTION | PROCEDURE) object <...> | BEGIN ... | _statement
drop_trigger = DROP TRIGGER _if_exists? object (ON object)? _cascade?
set_statement = SET (SESSION | LOCAL | GLOBAL)? (object | word) ("=" | TO) (value | ON | OFF) ("," value)*
comment_on = COMMENT (IF EXISTS)? ON (TABLE | COLUMN | VIEW | WAREHOUSE | USER | ROLE | SCRIPT | EXTENSION | TRIGGER | AGGREGATE | DOMAIN | PROCEDURE | POLICY | RULE | SERVER | STAGE | CATALOG | VOLUME | SCHEMA | DATABASE | FUNCTION | INDEX | CONSTRAINT | TYPE | SEQUENCE | MATERIALIZED VIEW) object (ON object)? IS (string | NULL) | COMMENT (IF EXISTS)? ON word ..( IS ) IS (string | NULL)
call = CALL object <...>
'''

GRAMMARS["athena"] = r'''
_statement += show | msck | unload | prepare | execute
create_table = CREATE EXTERNAL? TABLE _if_not_exists? object (<column_definition %? ",">)? table_option* (AS query)?
table_option += PARTITIONED BY <(column_definition | expr) % ","> | CLUSTERED BY _names INTO number BUCKETS | ROW FORMAT (SERDE string (WITH SERDEPROPERTIES <...>)? | DELIMITED (..( STORED | LOCATION | TBLPROPERTIES ) | ...))
  | STORED AS (INPUTFORMAT string OUTPUTFORMAT string | word) | LOCATION string | TBLPROPERTIES <...> | WITH <...>
show = SHOW (CREATE | COLUMNS | PARTITIONS | TBLPROPERTIES | TABLES | VIEWS | DATABASES | SCHEMAS) ...
msck = MSCK REPAIR TABLE object
unload = UNLOAD <query> TO string WITH <...>
prepare = PREPARE name FROM (query | _statement)
execute = EXECUTE name (USING value % ",")?
alter_action += ADD _if_not_exists? (PARTITION <...> (LOCATION string)?)+ | DROP _if_exists? (PARTITION <...>) % "," | SET (LOCATION string | TBLPROPERTIES <...>) | (ADD | REPLACE) COLUMNS <column_definition % ",">
'''

GRAMMARS["bigquery"] = r'''
_statement += declare | assert_statement | export_data | create_procedure | create_search_index | execute_immediate | _scripting | create_snapshot | alter_options
create_table = CREATE _or_replace? (TEMP | TEMPORARY | SNAPSHOT | EXTERNAL)? TABLE _if_not_exists? object ((LIKE | COPY | CLONE) object)? (<table_element %? ",">)? table_option* (AS query)?
column_definition = name type column_constraint*
column_constraint += OPTIONS <...>
table_option += PARTITION BY expr | CLUSTER BY object % "," | OPTIONS <...> | DEFAULT COLLATE string
create_view = CREATE _or_replace? MATERIALIZED? VIEW _if_not_exists? object (<(name (OPTIONS <...>)?) % ",">)? table_option* AS query
create_schema = CREATE SCHEMA _if_not_exists? object table_option*
create_function = CREATE _or_replace? (TEMP | TEMPORARY)? (AGGREGATE | TABLE)? FUNCTION _if_not_exists? object <(name (ANY TYPE | type)) % ","> (RETURNS type)? function_part+ | CREATE _or_replace? (TEMP | TEMPORARY)? FUNCTION _if_not_exists? object <> (RETURNS type)? function_part+
function_part += OPTIONS <...> | AS <expr> | AS query
merge = MERGE INTO? object alias? USING merge_source ON expr merge_match+
table_option += WITH PARTITION COLUMNS <...>? | WITH CONNECTION object
merge_insert += INSERT ROW | INSERT _names? ROW
insert = INSERT INTO? object _names? _insert_source
delete = DELETE FROM? object alias? where
declare = DECLARE name % "," type? (DEFAULT expr)?
set_statement = SET (object | _names | word) "=" expr
assert_statement = ASSERT expr (AS string)?
export_data = EXPORT DATA (WITH CONNECTION object)? OPTIONS <...> AS query
create_procedure = CREATE _or_replace? PROCEDURE _if_not_exists? object <...> (OPTIONS <...>)? BEGIN ...
create_search_index = CREATE (SEARCH | VECTOR) INDEX _if_not_exists? object ON object <...> (OPTIONS <...>)?
execute_immediate = EXECUTE IMMEDIATE expr (INTO name % ",")? (USING (expr alias?) % ",")?
create_snapshot = CREATE SNAPSHOT TABLE _if_not_exists? object CLONE object ...
alter_options = ALTER (TABLE | VIEW | SCHEMA | MATERIALIZED VIEW) _if_exists? object SET OPTIONS <...>
_scripting = FOR name IN <query> DO ... | REPEAT ... | UNTIL expr END REPEAT | IF expr THEN ... | LOOP ... | WHILE expr DO ... | END (IF | LOOP | WHILE | FOR)? | BEGIN ... | BREAK | LEAVE | RETURN | RAISE ...
'''

GRAMMARS["clickhouse"] = r'''
_statement += create_dictionary | drop_dictionary | system | optimize | rename | attach | exchange | kill | show | drop_quota
_on_cluster = ON CLUSTER (name | string)
create_table = CREATE _or_replace? (TEMPORARY)? TABLE _if_not_exists? object _on_cluster? (<clickhouse_element %? ","> | AS object (<...>)?)? table_option* (AS query)?
clickhouse_element = (INDEX | CONSTRAINT | PROJECTION) ... | ..( "," ) | column_definition
column_definition = name type? column_constraint*
column_constraint += (MATERIALIZED | ALIAS | EPHEMERAL | DEFAULT) expr | CODEC <...> | TTL expr
table_option += ENGINE "="? name <...>? | ORDER BY (<...> | expr) | PARTITION BY expr | PRIMARY KEY (<...> | expr) | SAMPLE BY expr | TTL (expr (DELETE where? | TO (VOLUME | DISK) string | RECOMPRESS CODEC <...> | GROUP BY exprs (SET assignment % ",")?)?) % "," | SETTINGS (name "=" value) % ","
create_view = CREATE _or_replace? (LIVE | WINDOW)? VIEW _if_not_exists? object _on_cluster? _names? _on_cluster? (DEFINER "=" name | SQL SECURITY name)* AS query | CREATE MATERIALIZED VIEW _if_not_exists? object _on_cluster? (REFRESH (EVERY | AFTER) number word)? (TO object)? (<...>)? table_option* POPULATE? AS query
create_user = CREATE USER _if_not_exists? (name | string) % "," ...
create_database = CREATE DATABASE _if_not_exists? object _on_cluster? (ENGINE "=" name <...>? (SETTINGS (name "=" value) % ",")?)? (COMMENT (string | name))?
drop_user = DROP USER _if_exists? (name | string) % "," _on_cluster?
drop_role = DROP ROLE _if_exists? name % "," _on_cluster?
drop_view = DROP VIEW _if_exists? object % "," _on_cluster? SYNC?
drop_function = DROP FUNCTION _if_exists? object _on_cluster?
create_role = CREATE ROLE _if_not_exists? name % "," ...
access += (GRANT | REVOKE) ..( TO | FROM ) (TO | FROM) grantee % "," ...
create_dictionary = CREATE _or_replace? DICTIONARY _if_not_exists? object _on_cluster? <...> (PRIMARY KEY name % "," | (SOURCE | LIFETIME | LAYOUT | RANGE | SETTINGS) <...> | COMMENT string)*
drop_dictionary = DROP DICTIONARY _if_exists? object SYNC?
drop_table = DROP TEMPORARY? TABLE _if_exists? object % "," _on_cluster? (SYNC | NO DELAY)*
drop_quota = DROP (QUOTA | name? PROFILE | ROW POLICY) _if_exists? name % "," _on_cluster?
insert = INSERT INTO (TABLE? FUNCTION object <...> | TABLE? object) _names? (SETTINGS (name "=" value) % ",")? (FORMAT name ... | _insert_source)
system = SYSTEM (START | STOP | FLUSH | RELOAD | DROP | SYNC | RESTART | RESTORE | SHUTDOWN | UNFREEZE | KILL) ...
optimize = OPTIMIZE TABLE object _on_cluster? (PARTITION expr)? FINAL? (DEDUPLICATE (BY name % ",")?)?
rename = RENAME (TABLE | DATABASE | DICTIONARY)? (object TO object) % "," _on_cluster?
exchange = EXCHANGE (TABLES | DICTIONARIES) object AND object _on_cluster?
attach = (ATTACH | DETACH) (TABLE | DATABASE | VIEW | DICTIONARY) (_if_exists | _if_not_exists)? object _on_cluster? PERMANENTLY?
kill = KILL (QUERY | MUTATION) where (SYNC | ASYNC | TEST)?
show = SHOW ...
alter_table = ALTER TABLE object _on_cluster? alter_action % ","
alter_action += COMMENT (COLUMN _if_exists? name)? string | MODIFY? COMMENT string | MODIFY COLUMN _if_exists? name REMOVE word | MODIFY COLUMN? name MODIFY SETTING ... | MODIFY COMMENT string | (DELETE where | UPDATE assignment % "," where) | (ADD | DROP | CLEAR | MATERIALIZE) (INDEX | PROJECTION | CONSTRAINT | COLUMN) ... | (DROP | DETACH | ATTACH | FREEZE | FETCH | MOVE | REPLACE) PARTITION ... | MODIFY (TTL expr | ORDER BY expr | SETTING (name "=" value) % "," | COLUMN? column_definition) | RESET SETTING name % ","
'''

GRAMMARS["hive"] = r'''
_statement += alter_database | hive_set | load_data | msck | show | export | import | reload | analyze | create_macro
create_table = CREATE (TEMPORARY | TRANSACTIONAL | EXTERNAL | MANAGED)* TABLE _if_not_exists? object (LIKE object | <table_element %? ",">)? table_option* (AS query)?
column_definition = name ":"? type column_constraint*
table_option += PARTITIONED BY (<(column_definition | name) % ","> | SPEC <...>) | CLUSTERED BY _names (SORTED BY <...>)? INTO number BUCKETS | SKEWED BY _names ON <...> (STORED AS DIRECTORIES)?
  | ROW FORMAT (SERDE string (WITH SERDEPROPERTIES <...>)? | DELIMITED row_part*) | STORED (AS (INPUTFORMAT string OUTPUTFORMAT string | word) | BY string (WITH SERDEPROPERTIES <...>)?) | LOCATION string | TBLPROPERTIES <...>
row_part = (FIELDS | COLLECTION ITEMS | MAP KEYS | LINES) TERMINATED BY string (ESCAPED BY string)? | NULL DEFINED AS string
alter_database = ALTER (DATABASE | SCHEMA) object SET (DBPROPERTIES <...> | (LOCATION | MANAGEDLOCATION) string | OWNER (TO | USER | ROLE)? (name | string))
hive_set = SET | SET "-" word
truncate = TRUNCATE TABLE? object partition?
_deferral += (ENABLE | DISABLE | VALIDATE | NOVALIDATE | RELY | NORELY)
partition = PARTITION <(name ("=" value)?) % ",">
insert = INSERT (OVERWRITE | INTO) TABLE? object partition? _if_not_exists? _names? _insert_source | INSERT OVERWRITE LOCAL? DIRECTORY string table_option* query
load_data = LOAD DATA LOCAL? INPATH string OVERWRITE? INTO TABLE object partition?
msck = MSCK REPAIR? TABLE object ((ADD | DROP | SYNC) PARTITIONS)?
show = SHOW word ...
export = EXPORT TABLE object partition? TO string
import = IMPORT (EXTERNAL? TABLE object partition?)? FROM string (LOCATION string)?
reload = RELOAD (FUNCTION | FUNCTIONS)
analyze = ANALYZE TABLE object partition? COMPUTE STATISTICS (FOR COLUMNS (name % ",")? | FOR ALL COLUMNS | NOSCAN)?
create_macro = CREATE TEMPORARY MACRO name <...> expr | DROP TEMPORARY MACRO _if_exists? name
create_database = CREATE (DATABASE | SCHEMA) _if_not_exists? object (COMMENT string | LOCATION string | MANAGEDLOCATION string | WITH DBPROPERTIES <...>)*
alter_table = ALTER TABLE object partition? alter_action % ","
alter_action += EXCHANGE partition WITH TABLE object | SET (TBLPROPERTIES <...> | SERDEPROPERTIES <...> | SERDE string | LOCATION string | FILEFORMAT word) | UNSET TBLPROPERTIES _if_exists? <...> | ADD _if_not_exists? (partition (LOCATION string)?)+ | DROP _if_exists? partition % "," PURGE? | RENAME TO partition | RECOVER PARTITIONS
  | (ADD | REPLACE) COLUMNS <column_definition % ","> | (CLUSTERED | SORTED) BY <...> | CONCATENATE | COMPACT string
create_function = CREATE TEMPORARY? FUNCTION object AS string (USING (((JAR | FILE | ARCHIVE) string) % ","))?
'''

GRAMMARS["sparksql"] = r'''
_statement += replace_table | _constraint | create_widget | cache | uncache | refresh | clear_cache | add_resource | reset | declare | _delta | alter_view | list_resource
_table_kind += OR REFRESH | STREAMING | LIVE | STREAMING LIVE | OR REFRESH STREAMING | OR REFRESH STREAMING LIVE | OR REFRESH LIVE | TEMPORARY LIVE
create_table = CREATE _or_replace? (OR REFRESH)? (TEMPORARY | EXTERNAL | STREAMING | LIVE)* TABLE _if_not_exists? object (LIKE object | <_spark_element %? ",">)? table_option* (AS? query)?
_spark_element = table_element | expectation
expectation = CONSTRAINT name EXPECT <expr> (ON VIOLATION (FAIL UPDATE | DROP ROW))?
table_option += USING object | OPTIONS <...> | CLUSTER BY (_names | AUTO | NONE) | PARTITIONED BY <(expr | column_definition) % ",">
create_view = CREATE _or_replace? (OR REFRESH)? (GLOBAL? (TEMPORARY | TEMP))? (STREAMING | LIVE | MATERIALIZED)* VIEW _if_not_exists? object (<(name (COMMENT string)? | expectation) % ",">)? (COMMENT string | TBLPROPERTIES <...> | USING object | OPTIONS <...>)* (AS query)?
alter_view = ALTER VIEW object (RENAME TO object | SET TBLPROPERTIES <...> | UNSET TBLPROPERTIES _if_exists? <...> | AS query)
insert = INSERT (OVERWRITE | INTO) TABLE? object partition? _if_not_exists? (_names | BY NAME)? _insert_source | INSERT OVERWRITE LOCAL? DIRECTORY string? table_option* query | INSERT INTO TABLE? object REPLACE WHERE expr _insert_source
_insert_source += TABLE object | FROM ...
replace_table = REPLACE TABLE object ...
drop_function = DROP TEMPORARY? FUNCTION _if_exists? object
_constraint = expectation
create_widget = CREATE WIDGET word name DEFAULT string (CHOICES query)? | REMOVE WIDGET name
analyze += ANALYZE TABLES (IN object)? COMPUTE STATISTICS NOSCAN?
alter_action += SET SERDE string (WITH SERDEPROPERTIES <...>)? | CHANGE COLUMN? object name type column_constraint* _position? | RENAME COLUMN object TO object | ALTER COLUMN? object COMMENT string | ADD (COLUMN | COLUMNS) object type column_constraint* _position? | (ADD | DROP | REPLACE) PARTITION FIELD ... | WRITE ... | (ALTER | CHANGE) COLUMN? object (COMMENT string | _position | (SET | DROP) NOT NULL | TYPE type | SET DEFAULT value | DROP DEFAULT) | (ADD | DROP | REPLACE) (COLUMN | COLUMNS) _if_exists? <...> | (ADD | DROP | REPLACE) COLUMNS (column_definition _position?) % "," | DROP CONSTRAINT ... | ADD CONSTRAINT ...
cache = CACHE LAZY? TABLE object (OPTIONS <...>)? (AS? query)?
uncache = UNCACHE TABLE _if_exists? object
refresh = REFRESH (TABLE | FUNCTION | MATERIALIZED VIEW | STREAMING TABLE)? (object | string)
clear_cache = CLEAR CACHE
add_resource = ADD (JAR | JARS | FILE | FILES | ARCHIVE | ARCHIVES) ...
list_resource = LIST (JAR | JARS | FILE | FILES | ARCHIVE | ARCHIVES) ...
reset = RESET (..( ";" ) | ...)
declare = DECLARE _or_replace? VARIABLE? name type? ((DEFAULT | "=") expr)?
set_statement += SET object | SET TIME ZONE ... | SET (VARIABLE | VAR)? (object | _names) "=" expr | SET | SET "-" word | SET TIME ZONE (LOCAL | string | expr)
_delta = VACUUM (object | string) (RETAIN number HOURS)? (DRY RUN)? | OPTIMIZE (object | string) where? (ZORDER BY <name % ",">)? | RESTORE TABLE? object TO? (VERSION | TIMESTAMP) AS OF value
  | GENERATE name FOR TABLE (object | string) | CONVERT TO DELTA object (NO STATISTICS)? (PARTITIONED BY <...>)? (NO STATISTICS)? | apply_changes
apply_changes = APPLY CHANGES INTO object FROM (STREAM <object> | object) KEYS <object % ","> apply_part+
apply_part = IGNORE NULL UPDATES | where | APPLY AS (DELETE | TRUNCATE) WHEN expr | SEQUENCE BY expr | COLUMNS (<...> | "*" EXCEPT <...>) | STORED AS SCD TYPE number | TRACK HISTORY ON (("*" EXCEPT)? <...> | name % ",")
create_function = CREATE _or_replace? TEMPORARY? FUNCTION _if_not_exists? object (AS string (USING ((JAR | FILE | ARCHIVE) string) % ",")? | <(name type (DEFAULT value)? (COMMENT string)?) % ","> function_part* | <> function_part*)
function_part += RETURNS (TABLE <...>? | type) | RETURN (query | expr) | CONTAINS SQL | READS SQL DATA
describe = (DESCRIBE | DESC) (EXTENDED | FORMATTED | TABLE | DATABASE | SCHEMA | FUNCTION | HISTORY | DETAIL | QUERY)* (object partition? object? | string | query) (LIMIT number)?
'''

GRAMMARS["databricks"] = r'''
_statement += alter_catalog | create_catalog | create_volume | copy_into | comment_on | set_tags | create_flow | _drops | show
alter_catalog = ALTER CATALOG name (SET? OWNER TO any | ...)
access += GRANT !ON ..( TO ) TO grantee % "," ... | REVOKE !ON ..( FROM ) FROM grantee % "," ...
create_catalog = CREATE CATALOG _if_not_exists? name (USING SHARE object | MANAGED LOCATION string | COMMENT string)*
create_volume = CREATE EXTERNAL? VOLUME _if_not_exists? object (LOCATION string | COMMENT string)*
_drops = DROP (CATALOG | VOLUME | CONNECTION | SHARE | RECIPIENT | STREAMING TABLE) _if_exists? object _cascade?
copy_into = COPY INTO object <...>? FROM (string | <query>) (FILEFORMAT "=" name | VALIDATE ... | (FILES | PATTERN) "=" value | (FORMAT_OPTIONS | COPY_OPTIONS) <...>)*
use = USE (CATALOG | SCHEMA | DATABASE)? (object | string)
set_tags = (SET | UNSET) TAG ON (CATALOG | SCHEMA | TABLE | VOLUME | COLUMN) object name ("=" value)?
create_flow = CREATE FLOW name AS (INSERT INTO object BY NAME query | apply_changes)
alter_action += SET TAGS <...> | UNSET TAGS <...> | CLUSTER BY (_names | NONE | AUTO) | ALTER COLUMN name (SET MASK object (USING COLUMNS <...>)? | DROP MASK | COMMENT string | SYNC IDENTITY) | SET ROW FILTER object ON _names | DROP ROW FILTER | ADD COLUMN <column_definition % ",">
grantee = string | name
'''

GRAMMARS["db2"] = r'''
_statement += declare_table | call
declare_table = DECLARE GLOBAL TEMPORARY TABLE object <table_element %? ","> table_option*
table_option += IN name | ORGANIZE BY (ROW | COLUMN) | DATA CAPTURE word | NOT LOGGED | WITH REPLACE | DISTRIBUTE BY HASH _names | COMPRESS (YES | NO)
column_constraint += FOR BIT DATA | INLINE LENGTH number | WITH DEFAULT value? | CCSID word
'''

GRAMMARS["postgres"] = r'''
_statement += load | copy | create_type | create_extension | create_policy | create_domain | do | listen | vacuum | analyze | reindex | cluster | lock | prepare | execute | create_materialized_view | refresh
  | create_publication | create_procedure | alter_many | drop_many | show | discard | reset | create_aggregate | create_operator | create_server | create_statistics | import_schema | declare_cursor | fetch | create_rule | checkpoint | deallocate | security_label | set_transaction | reassign | create_tablespace
access += GRANT !ON ..( TO ) TO grantee % "," ... | REVOKE !ON ..( FROM ) FROM grantee % "," ...
_conflict = ON CONFLICT (ON CONSTRAINT name | <...> where?)? DO (NOTHING | UPDATE SET assignment % "," where?)
insert = INSERT INTO object alias? _names? (OVERRIDING (SYSTEM | USER) VALUE)? _insert_source _conflict? returning?
create_table = CREATE _table_kind? TABLE _if_not_exists? object (PARTITION OF object (<...>)? _partition_bound | OF object (<...>)? | _table_body | <>) table_option*
_partition_bound = FOR VALUES (IN <...> | FROM <...> TO <...> | WITH <...>) | DEFAULT
table_option += INHERITS <object % ","> | PARTITION BY (RANGE | LIST | HASH) <...> | WITH <...> | WITHOUT OIDS | TABLESPACE name | USING name | WITH NO? DATA
column_constraint += USING INDEX TABLESPACE name | STORAGE word | COMPRESSION word
table_constraint += (CONSTRAINT name)? EXCLUDE (USING name)? <...> where? | (CONSTRAINT name)? (PRIMARY KEY | UNIQUE) (NULLS NOT? DISTINCT)? <...> (INCLUDE <...>)? (WITH <...>)?
create_index = CREATE UNIQUE? INDEX CONCURRENTLY? _if_not_exists? object? ON ONLY? object (USING name)? <...> (INCLUDE <...>)? (NULLS NOT? DISTINCT)? (WITH <...>)? (TABLESPACE name)? where?
drop_index = DROP INDEX CONCURRENTLY? _if_exists? object % "," _cascade?
create_materialized_view = CREATE _or_replace? MATERIALIZED VIEW _if_not_exists? object _names? (USING name | WITH <...> | TABLESPACE name)* AS query (WITH NO? DATA)?
create_view = CREATE _or_replace? (TEMP | TEMPORARY)? RECURSIVE? VIEW object _names? (WITH <...>)? AS (query | values) (WITH (CASCADED | LOCAL)? CHECK OPTION)?
refresh = REFRESH MATERIALIZED VIEW CONCURRENTLY? object (WITH NO? DATA)?
copy = COPY BINARY? (object _names? | <query | _statement>) (FROM | TO) (PROGRAM? string | STDIN | STDOUT) WITH? (<...> | ...) where?
create_type = CREATE TYPE object (AS (ENUM <...> | RANGE <...> | <...> | <(name type (COLLATE object)?) % ","> | <>) | <...>)?
create_domain = CREATE DOMAIN object AS? type ((CONSTRAINT name)? (NOT NULL | NULL | CHECK <expr>) | DEFAULT value | COLLATE object)*
create_extension = CREATE EXTENSION _if_not_exists? name WITH? (SCHEMA name | VERSION (string | name) | FROM (string | name) | CASCADE)*
create_policy = (CREATE | ALTER) POLICY name ON object (RENAME TO name | AS (PERMISSIVE | RESTRICTIVE) | FOR (ALL | SELECT | INSERT | UPDATE | DELETE) | TO grantee % "," | USING <expr> | WITH CHECK <expr>)*
create_procedure = CREATE _or_replace? PROCEDURE object <...> function_part+
create_function = CREATE _or_replace? FUNCTION object <...> (RETURNS (TABLE <...> | SETOF? type | TRIGGER))? function_part+
function_part += CALLED ON NULL INPUT | RETURNS NULL ON NULL INPUT | NOT? LEAKPROOF | SECURITY (DEFINER | INVOKER) | PARALLEL word | COST number | ROWS number | WINDOW | SET name (TO | "=" | FROM) (value | CURRENT) | AS string "," string | BEGIN ATOMIC ... | TRANSFORM ...
create_aggregate = CREATE _or_replace? AGGREGATE object <...> <...>
create_operator = CREATE (OPERATOR (CLASS | FAMILY)? | COLLATION | TEXT SEARCH word | ACCESS METHOD | LANGUAGE | EVENT TRIGGER | CONVERSION) ...
comment_on += COMMENT ON word+ object <...>? (ON object)? IS (string | NULL)
load = LOAD string
create_server = CREATE (SERVER | FOREIGN TABLE | FOREIGN DATA WRAPPER | USER MAPPING) ...
create_statistics = CREATE STATISTICS _if_not_exists? object? (<...>)? ON ..( FROM ) FROM object
create_publication = CREATE (PUBLICATION | SUBSCRIPTION) name ...
create_rule = CREATE _or_replace? RULE name AS ON (SELECT | INSERT | UPDATE | DELETE) TO object where? DO (ALSO | INSTEAD)? (NOTHING | <...> | query | _statement)
create_tablespace = CREATE TABLESPACE name (OWNER name)? LOCATION string (WITH <...>)?
import_schema = IMPORT FOREIGN SCHEMA name ((LIMIT TO | EXCEPT) <...>)? FROM SERVER name INTO name (OPTIONS <...>)?
create_schema = CREATE SCHEMA (_if_not_exists? AUTHORIZATION name | _if_not_exists? object (AUTHORIZATION name)?) _statement*
create_database = CREATE DATABASE object WITH? (CONNECTION LIMIT "="? value | word "="? value)*
create_user = CREATE (USER | GROUP) _if_not_exists? name WITH? role_option*
create_role = CREATE ROLE _if_not_exists? name WITH? role_option*
role_option = ENCRYPTED? PASSWORD (string | NULL) | VALID UNTIL string | CONNECTION LIMIT value | (IN (ROLE | GROUP) | ROLE | ADMIN | USER) name % "," | !ALTER name
do = DO (LANGUAGE name)? string (LANGUAGE name)?
listen = (LISTEN | UNLISTEN | NOTIFY) (name | "*") ("," string)?
vacuum = VACUUM (<...> | (FULL | FREEZE | VERBOSE | ANALYZE | ANALYSE)*) (object _names?) % "," | VACUUM (<...> | (FULL | FREEZE | VERBOSE | ANALYZE | ANALYSE)*)
analyze = (ANALYZE | ANALYSE) (<...>)? VERBOSE? ((object _names?) % ",")?
reindex = REINDEX (<...>)? (INDEX | TABLE | SCHEMA | DATABASE | SYSTEM) CONCURRENTLY? object
cluster = CLUSTER VERBOSE? (object (USING name | ON object)?)?
lock = LOCK TABLE? ONLY? object % "," (IN ..( MODE ) MODE)? NOWAIT?
prepare = PREPARE name (<...>)? AS (query | _statement)
execute = EXECUTE name (<...>)?
deallocate = DEALLOCATE PREPARE? (name | ALL)
explain = EXPLAIN (<...> | ANALYZE | ANALYSE | VERBOSE)* (query | _statement)
show = SHOW (ALL | object | word+)
discard = DISCARD (ALL | PLANS | SEQUENCES | TEMP | TEMPORARY)
reset = RESET (ALL | object)
checkpoint = CHECKPOINT
declare_cursor = DECLARE name (BINARY | INSENSITIVE | ASENSITIVE | NO? SCROLL)* CURSOR ((WITH | WITHOUT) HOLD)? FOR query | CLOSE (ALL | name)
fetch = (FETCH | MOVE) ...
security_label = SECURITY LABEL (FOR name)? ON word object IS (string | NULL)
set_transaction = SET (SESSION CHARACTERISTICS AS)? TRANSACTION ... | SET CONSTRAINTS (ALL | object % ",") (DEFERRED | IMMEDIATE) | SET (SESSION | LOCAL)? (ROLE | SESSION AUTHORIZATION) (name | string | NONE | DEFAULT) | SET (SESSION | LOCAL)? TIME ZONE (value | LOCAL | DEFAULT)
reassign = REASSIGN OWNED BY grantee % "," TO name | DROP OWNED BY grantee % "," _cascade?
alter_many = ALTER (SEQUENCE | TEXT SEARCH word | ACCESS METHOD | LANGUAGE | GROUP | DATABASE | DEFAULT PRIVILEGES | DOMAIN | EXTENSION | FUNCTION | PROCEDURE | ROUTINE | INDEX | MATERIALIZED VIEW | VIEW | ROLE | USER | SCHEMA | TYPE | TRIGGER | PUBLICATION | SUBSCRIPTION | SERVER | FOREIGN TABLE | AGGREGATE | OPERATOR | STATISTICS | TABLESPACE | EVENT TRIGGER | RULE | COLLATION) any ...
drop_many = DROP (TEXT SEARCH word | ACCESS METHOD | LANGUAGE | USER MAPPING | FOREIGN DATA WRAPPER | DOMAIN | EXTENSION | MATERIALIZED VIEW | PROCEDURE | ROUTINE | AGGREGATE | POLICY | PUBLICATION | SUBSCRIPTION | RULE | SERVER | FOREIGN TABLE | STATISTICS | TABLESPACE | OPERATOR | COLLATION | EVENT TRIGGER | GROUP) _if_exists? any ...
alter_table = ALTER TABLE _if_exists? ONLY? object "*"? alter_action % ","
alter_action += ADD table_constraint (NOT VALID)? (USING INDEX name)? | VALIDATE CONSTRAINT name | (ENABLE | DISABLE | FORCE | NO FORCE) (ALWAYS | REPLICA)? (TRIGGER name | RULE name | ROW LEVEL SECURITY | TRIGGER (ALL | USER)) | ALTER COLUMN? name ((SET DATA)? TYPE type (COLLATE object)? (USING expr)? | SET (STATISTICS value | STORAGE word | <...>) | RESET <...> | ADD GENERATED ... | DROP (IDENTITY | EXPRESSION) _if_exists? | SET GENERATED ...)
  | ALTER CONSTRAINT name _deferral* | CLUSTER ON name | SET (WITHOUT (CLUSTER | OIDS) | TABLESPACE name | LOGGED | UNLOGGED | ACCESS METHOD name | <...>) | RESET <...> | NO? INHERIT object | (ATTACH PARTITION object _partition_bound) | DETACH PARTITION object (CONCURRENTLY | FINALIZE)? | REPLICA IDENTITY ... | NOT? OF object
transaction += (ABORT | PREPARE TRANSACTION string | (COMMIT | ROLLBACK) PREPARED string)
truncate = TRUNCATE TABLE? (ONLY? object "*"?) % "," _truncate_how?
delete = DELETE FROM ONLY? object "*"? alias? (USING ..( WHERE | RETURNING ))? (WHERE CURRENT OF name | where)? returning?
create_trigger = CREATE _or_replace? CONSTRAINT? TRIGGER name (BEFORE | AFTER | INSTEAD OF) trigger_event (OR trigger_event)* ON object (FROM object)? _deferral* (REFERENCING ((OLD | NEW) TABLE AS? name)+)? (FOR EACH? (ROW | STATEMENT))? (WHEN <expr>)? EXECUTE (FUNCTION | PROCEDURE) object <...>
'''

GRAMMARS["duckdb"] = r'''
_statement += attach | pragma | install | export_database | summarize | create_macro | create_secret | pivot_statement | unpivot_statement
create_table = CREATE _or_replace? _table_kind? TABLE _if_not_exists? object _table_body table_option*
_table_body += AS FROM ...
column_definition = name type? (AS <expr>)? column_constraint*
insert = INSERT (OR (REPLACE | IGNORE))? INTO object alias? (BY (NAME | POSITION))? _names? _insert_source _conflict? returning?
_insert_source += FROM ...
attach = ATTACH DATABASE? _if_not_exists? string (AS name)? <...>? | DETACH DATABASE? _if_exists? name
pragma = PRAGMA name ("=" value | <...>)?
install = (FORCE? INSTALL | LOAD) (name | string) (FROM (name | string))?
export_database = (EXPORT | IMPORT) DATABASE string <...>?
summarize = SUMMARIZE (object | query | string)
create_macro = CREATE _or_replace? (TEMP | TEMPORARY)? (MACRO | FUNCTION) object <...> AS (TABLE query | expr)
create_secret = CREATE _or_replace? PERSISTENT? SECRET name? <...>
pivot_statement = (PIVOT | PIVOT_WIDER) any ...
unpivot_statement = (UNPIVOT | PIVOT_LONGER) any ...
create_type = CREATE TYPE object AS (ENUM <...> | type)
'''

GRAMMARS["exasol"] = r'''
_statement += _exa_script | create_script | execute_script | create_connection | create_virtual_schema | flush | import | export | open_schema | recompress | kill | create_consumer_group | impersonate | alter_many | drop_many | preload | rename
create_table = CREATE _or_replace? TABLE _if_not_exists? object (LIKE object ((INCLUDING | EXCLUDING) word)* | <(table_element | DISTRIBUTE BY name % "," | PARTITION BY name % ",") % ","> | AS query (WITH NO? DATA)?) table_option*
table_option += COMMENT IS string
column_constraint += IDENTITY number? | COMMENT IS string | DISABLE | ENABLE
table_element += LIKE object ((INCLUDING | EXCLUDING) word)*
access += GRANT !ON ..( TO ) TO grantee % "," ... | REVOKE !ON ..( FROM ) FROM grantee % "," ...
comment_on += COMMENT ON TABLE? object (IS string)? <...>? | COMMENT ON word+ object IS string
explain += EXPLAIN VIRTUAL query
update = UPDATE object alias? SET assignment % "," (FROM ..( WHERE | PREFERRING ))? (FROM ...)? where? (PREFERRING ...)?
create_view = CREATE _or_replace? FORCE? VIEW object (<(name (COMMENT IS string)?) % ",">)? AS query (COMMENT IS string)?
create_script = CREATE _or_replace? (PYTHON | PYTHON3 | LUA | JAVA | R)? (SCALAR | SET | ADAPTER)? SCRIPT object ...
execute_script = EXECUTE SCRIPT object (<...>)? (WITH OUTPUT)?
create_connection = (CREATE _or_replace? | ALTER) CONNECTION name TO (string | name) (USER string IDENTIFIED BY string)?
create_virtual_schema = (CREATE VIRTUAL SCHEMA _if_not_exists? name USING object (WITH ...)? | ALTER VIRTUAL SCHEMA name any ... | DROP FORCE? VIRTUAL SCHEMA _if_exists? name _cascade?)
flush = FLUSH STATISTICS | TRUNCATE AUDIT LOGS ...
import = IMPORT (INTO (object _names? | <...>))? FROM any ...
export = EXPORT (object _names? | <query>) INTO any ...
open_schema = OPEN SCHEMA name | CLOSE SCHEMA
recompress = (RECOMPRESS | REORGANIZE) (TABLE | TABLES | SCHEMA | DATABASE) ...
kill = KILL (SESSION | STATEMENT) ...
create_consumer_group = CREATE CONSUMER GROUP name WITH (name "=" value) % "," | ALTER CONSUMER GROUP name SET (name "=" value) % ","
impersonate = IMPERSONATE name
preload = PRELOAD (TABLE | TABLES | SCHEMA | SCHEMAS | DATABASE) ...
rename = RENAME (SCHEMA | TABLE | VIEW | FUNCTION | SCRIPT | USER | ROLE | CONNECTION)? object TO object
alter_many = ALTER (USER | ROLE | SCHEMA | SESSION | SYSTEM | TABLE) any ...
drop_many = DROP (SCRIPT | CONNECTION | CONSUMER GROUP | ADAPTER SCRIPT) _if_exists? object
create_user = CREATE USER name IDENTIFIED (BY (name | string) | AT LDAP AS string ... | BY KERBEROS PRINCIPAL string | BY OPENID SUBJECT string)
merge = MERGE INTO object alias? USING merge_source ON expr merge_match+
create_function = CREATE _or_replace? FUNCTION object <...> RETURN type (IS | AS)? ...
_exa_script = BEGIN ... | name ":" "=" expr | RETURN expr | END any? | IF ... | FOR ... | WHILE ... | ELSE ...
delete = DELETE "*"? FROM object !PREFERRING alias? where? (PREFERRING ...)? | DELETE "*"? FROM object PREFERRING ...
'''

GRAMMARS["greenplum"] = r'''
table_option += DISTRIBUTED (BY <...> | RANDOMLY | REPLICATED) | PARTITION BY (RANGE | LIST) <...> (SUBPARTITION BY ...)? <...>?
create_table += CREATE (READABLE | WRITABLE)? EXTERNAL (WEB | TEMPORARY)? TABLE object <...> ((LOCATION <...> | EXECUTE string) (ON (ALL | MASTER))? FORMAT string <...>? ...)
alter_action += SET DISTRIBUTED (BY <...> | RANDOMLY | REPLICATED) | SET WITH <...> DISTRIBUTED ... | (ADD | DROP | EXCHANGE | SPLIT | TRUNCATE | RENAME) (DEFAULT)? PARTITION ...
analyze += ANALYZE ROOTPARTITION (ALL | object)
'''

GRAMMARS["materialize"] = r'''
_statement += create_source | create_sink | create_cluster | create_connection | create_secret | subscribe | create_index | alter_more | drop_more | show_more | copy | validate_connection
create_materialized_view = CREATE _or_replace? MATERIALIZED VIEW _if_not_exists? object _names? (IN CLUSTER name)? (WITH <...>)? AS query
create_source = CREATE SOURCE _if_not_exists? object _names? (IN CLUSTER name)? FROM (KAFKA | POSTGRES | MYSQL | WEBHOOK | LOAD GENERATOR | SQL SERVER) ...
create_sink = CREATE SINK _if_not_exists? object? (IN CLUSTER name)? FROM object INTO KAFKA CONNECTION object <...> ...
create_cluster = CREATE CLUSTER name "="? (SIZE "="? value | REPLICAS <...> | <...>) ("," name "="? value)* | CREATE CLUSTER REPLICA object ...
create_connection = CREATE CONNECTION _if_not_exists? object TO (KAFKA | POSTGRES | MYSQL | AWS | AWS PRIVATELINK | SSH TUNNEL | CONFLUENT SCHEMA REGISTRY) <...>
create_secret = CREATE SECRET _if_not_exists? object AS value
create_index = CREATE (DEFAULT INDEX (IN CLUSTER name)? | INDEX name? (IN CLUSTER name)?) ON object (USING name)? <...>? (WITH <...>)?
subscribe = SUBSCRIBE TO? (object | <query>) (ENVELOPE ... | WITH <...> | AS OF value | UP TO value)*
validate_connection = VALIDATE CONNECTION object
alter_more = ALTER (CLUSTER | CONNECTION | SECRET | SINK | SOURCE | SYSTEM | INDEX) any ...
drop_more = DROP (CLUSTER REPLICA? | CONNECTION | SECRET | SINK | SOURCE) _if_exists? object % "," _cascade?
show_more = SHOW ...
explain += EXPLAIN ...
drop_role = DROP ROLE _if_exists? name % "," _cascade?
declare_cursor += DECLARE name CURSOR FOR subscribe
'''

GRAMMARS["mysql"] = r'''
_statement += delimiter | _label | create_event | alter_event | drop_event | create_procedure | drop_procedure | declare | _flow | replace | load_data | lock | unlock | prepare | execute | deallocate | flush | show | analyze | check | optimize | rename_table | reset | kill | help | create_option | resignal | cursor | alter_many | handler | purge
_character_set = DEFAULT? (CHARACTER SET | CHARSET) "="? (name | string | BINARY) | DEFAULT? COLLATE "="? (name | string)
column_definition = name type column_constraint*
column_constraint += ON UPDATE value | _character_set | KEY | INVISIBLE | VISIBLE | COLUMN_FORMAT word | STORAGE word | GENERATED ALWAYS AS <expr> (STORED | VIRTUAL)? | AS <expr> (STORED | VIRTUAL)? | SRID number | NOT? ENFORCED | ENGINE_ATTRIBUTE "="? string
table_element += (FULLTEXT | SPATIAL | UNIQUE)? (INDEX | KEY) name? (USING word)? <...> index_option* | FULLTEXT name? <...> index_option*
index_option = USING (BTREE | HASH) | COMMENT string | KEY_BLOCK_SIZE "="? number | VISIBLE | INVISIBLE | WITH PARSER name
delimiter = DELIMITER ... | END any? ... | DELIMITER
_label = name ":" (BEGIN | LOOP | REPEAT | WHILE) ...
table_constraint = (CONSTRAINT !FOREIGN name)? CONSTRAINT? (PRIMARY KEY (USING word)? <...> | UNIQUE (INDEX | KEY)? name? (USING word)? <...> | FOREIGN KEY name? _names references | CHECK <expr> (NOT? ENFORCED)?) index_option*
table_option += ","? ((ENGINE | AUTO_INCREMENT | AVG_ROW_LENGTH | CHECKSUM | COMPRESSION | CONNECTION | DELAY_KEY_WRITE | ENCRYPTION | INSERT_METHOD | KEY_BLOCK_SIZE | MAX_ROWS | MIN_ROWS | PACK_KEYS | ROW_FORMAT | STATS_AUTO_RECALC | STATS_PERSISTENT | TABLESPACE) "="? value | (DATA | INDEX) DIRECTORY "="? string | _character_set | UNION "="? <...>)
  | PARTITION BY LINEAR? (HASH | KEY | RANGE | LIST) COLUMNS? (ALGORITHM "=" number)? <...> (PARTITIONS number)? (SUBPARTITION BY LINEAR? (HASH | KEY) <...> (SUBPARTITIONS number)?)? <...>? | (IGNORE | REPLACE)
insert = INSERT (LOW_PRIORITY | DELAYED | HIGH_PRIORITY)? IGNORE? INTO? object (PARTITION _names)? (_names? _insert_source | <> _insert_source | SET assignment % ",") (AS name _names?)? (ON DUPLICATE KEY UPDATE assignment % ",")?
_insert_source += (values | VALUE <...>) AS name _names? | VALUE (<_row_value % ",">) % "," | VALUES (ROW <...>) % "," | TABLE object | VALUES <> % ","
replace = REPLACE (LOW_PRIORITY | DELAYED)? INTO? object (PARTITION _names)? (_names? _insert_source | SET assignment % ",")
update = UPDATE LOW_PRIORITY? IGNORE? ..( SET ) SET assignment % "," where? (ORDER BY ..( LIMIT ) )? (ORDER BY exprs)? (LIMIT number)?
delete = DELETE (LOW_PRIORITY | QUICK | IGNORE)* (FROM object alias? (PARTITION _names)? where? (ORDER BY exprs)? (LIMIT number)? | FROM ..( USING ) USING ... | ..( FROM ) FROM ...)
create_procedure = CREATE definer? PROCEDURE _if_not_exists? object <...> routine_part* routine_body
create_function = CREATE definer? AGGREGATE? FUNCTION _if_not_exists? object (<...> RETURNS type (_character_set)? routine_part* routine_body | RETURNS word SONAME string)
definer = DEFINER "=" (string | name | CURRENT_USER) ("@" (string | name))?
routine_part = COMMENT string | LANGUAGE SQL | NOT? DETERMINISTIC | CONTAINS SQL | NO SQL | READS SQL DATA | MODIFIES SQL DATA | SQL SECURITY (DEFINER | INVOKER)
routine_body = (name ":")? BEGIN ... | RETURN expr | query | _statement
drop_procedure = DROP PROCEDURE _if_exists? object
create_trigger = CREATE definer? TRIGGER _if_not_exists? object (BEFORE | AFTER) (INSERT | UPDATE | DELETE) ON object FOR EACH ROW ((FOLLOWS | PRECEDES) name)? routine_body
create_event = CREATE definer? EVENT _if_not_exists? object ON SCHEDULE (AT expr | EVERY ..( STARTS | ENDS | ON | DO | COMMENT | ENABLE | DISABLE )) (STARTS ..( ENDS | ON | DO ))? (ENDS ..( ON | DO ))? (ON COMPLETION NOT? PRESERVE)? (ENABLE | DISABLE (ON (SLAVE | REPLICA))?)? (COMMENT string)? DO routine_body
alter_event = ALTER definer? EVENT object any ...
drop_event = DROP EVENT _if_exists? object
create_view = CREATE _or_replace? (ALGORITHM "=" word)? definer? (SQL SECURITY (DEFINER | INVOKER))? VIEW object _names? AS query (WITH (CASCADED | LOCAL)? CHECK OPTION)?
create_index = CREATE (UNIQUE | FULLTEXT | SPATIAL)? INDEX name (USING word)? ON object <...> (index_option | (ALGORITHM | LOCK) "="? word)*
drop_index = DROP INDEX name ON object ((ALGORITHM | LOCK) "="? word)*
create_database = CREATE (DATABASE | SCHEMA) _if_not_exists? object (_character_set | DEFAULT? ENCRYPTION "="? string)*
alter_table = ALTER (ONLINE | IGNORE)? TABLE object alter_action % ","
alter_action += table_option | ADD table_element | ADD COLUMN? <column_definition % ","> | ADD COLUMN? column_definition _position? | DROP (INDEX | KEY | FOREIGN KEY | CHECK) name | RENAME (INDEX | KEY) name TO name | (ENABLE | DISABLE) KEYS | CONVERT TO CHARACTER SET name (COLLATE name)? | ORDER BY exprs | FORCE | (ALGORITHM | LOCK) "="? word | ALTER (INDEX name (VISIBLE | INVISIBLE) | (CHECK | CONSTRAINT) name NOT? ENFORCED) | CHANGE COLUMN? name column_definition _position?
  | (ADD | DROP | TRUNCATE | DISCARD | IMPORT | REORGANIZE | EXCHANGE | ANALYZE | CHECK | OPTIMIZE | REBUILD | REPAIR | COALESCE | REMOVE) (PARTITION | PARTITIONING) ... | (DISCARD | IMPORT) TABLESPACE
rename_table = RENAME TABLE (object TO object) % "," | RENAME USER (any TO any) % ","
load_data = LOAD (DATA | XML) (LOW_PRIORITY | CONCURRENT)? LOCAL? INFILE string (REPLACE | IGNORE)? INTO TABLE object ...
declare = DECLARE (name % "," type (DEFAULT expr)? | name CONDITION FOR ... | name CURSOR FOR query | (CONTINUE | EXIT | UNDO) HANDLER FOR ..( BEGIN | SET | SELECT ) routine_body | (CONTINUE | EXIT | UNDO) HANDLER FOR ...)
set_statement = SET (GLOBAL | SESSION | LOCAL | PERSIST | "@@")? ((object | any | NAMES) (("=" | ":=") (ON | expr))?) % "," | SET (NAMES | CHARACTER SET | CHARSET) (name | string) (COLLATE (name | string))? | SET (GLOBAL | SESSION)? TRANSACTION ... | SET PASSWORD ... | SET DEFAULT? ROLE ...
_flow = IF expr THEN ... | (ELSEIF | ELSE) ... | END (IF | LOOP | REPEAT | WHILE | CASE)? name? | (name ":")? (LOOP | REPEAT | WHILE) ... | (LEAVE | ITERATE) name | RETURN expr | UNTIL expr END REPEAT
resignal = (SIGNAL | RESIGNAL) ... | GET (CURRENT | STACKED)? DIAGNOSTICS ...
cursor = (OPEN | CLOSE) name | FETCH ((NEXT)? FROM)? name INTO name % ","
lock = LOCK (TABLE | TABLES) (object alias? (READ LOCAL? | LOW_PRIORITY? WRITE)) % "," | LOCK INSTANCE FOR BACKUP
unlock = UNLOCK (TABLE | TABLES | INSTANCE)
prepare = PREPARE name FROM (string | any)
execute = EXECUTE name (USING any % ",")?
deallocate = (DEALLOCATE | DROP) PREPARE name
flush = FLUSH ...
show = SHOW ...
analyze = ANALYZE (NO_WRITE_TO_BINLOG | LOCAL)? TABLE object % "," ...
check = (CHECK | CHECKSUM | REPAIR) (NO_WRITE_TO_BINLOG | LOCAL)? TABLE object % "," word*
optimize = OPTIMIZE (NO_WRITE_TO_BINLOG | LOCAL)? (TABLE | TABLES) object % ","
reset = RESET ...
kill = KILL (CONNECTION | QUERY)? value
help = HELP string
handler = HANDLER object any ...
purge = PURGE (BINARY | MASTER) LOGS ...
create_user = CREATE USER _if_not_exists? user_part % "," ...
user_part = any (any any)? (IDENTIFIED (BY (string | RANDOM PASSWORD) | WITH name ((BY | AS) string)?))?
drop_user = DROP USER _if_exists? (any (any any)?) % ","
create_role = CREATE ROLE _if_not_exists? (any (any any)?) % ","
grantee = any (any any)? (IDENTIFIED BY string)?
create_option = CREATE (SERVER | TABLESPACE | LOGFILE GROUP | RESOURCE GROUP | UNDO TABLESPACE) any ...
alter_many = ALTER (DATABASE | SCHEMA | USER | VIEW | PROCEDURE | FUNCTION | SERVER | TABLESPACE | INSTANCE | ALGORITHM | definer) any ...
explain = (EXPLAIN | DESCRIBE | DESC) (ANALYZE | EXTENDED | PARTITIONS | FORMAT "=" word)* (query | _statement | object name?)
transaction += (START TRANSACTION (WITH CONSISTENT SNAPSHOT | READ (ONLY | WRITE)) % "," | (COMMIT | ROLLBACK) WORK? (AND NO? CHAIN)? (NO? RELEASE)? | XA ...)
'''

GRAMMARS["oracle"] = r'''
_statement += create_package | create_procedure | _block | create_synonym | create_type | alter_many | drop_many | prompt | execute | comment_on | purge | flashback | rename | create_other | lock
column_constraint += ENABLE | DISABLE | USING INDEX ... | VISIBLE | INVISIBLE | SORT | ENCRYPT | DEFAULT ON NULL value
table_option += TABLESPACE name | (PCTFREE | PCTUSED | INITRANS | MAXTRANS) number | STORAGE <...> | (NO)? LOGGING | LOGGING | NOLOGGING | COMPRESS ... | NOCOMPRESS | PARALLEL number? | NOPARALLEL | CACHE | NOCACHE | ORGANIZATION (HEAP | INDEX | EXTERNAL <...>) | PARTITION BY (RANGE | LIST | HASH | REFERENCE | SYSTEM) <...>? (INTERVAL <...>)? (<...> | PARTITIONS number)? | SEGMENT CREATION (IMMEDIATE | DEFERRED) | (ENABLE | DISABLE) ROW MOVEMENT | LOB <...> STORE AS ...
table_option += ON COMMIT (DROP | PRESERVE) DEFINITION
_table_kind += GLOBAL TEMPORARY | PRIVATE TEMPORARY | SHARDED | IMMUTABLE | BLOCKCHAIN
create_view = CREATE _or_replace? (NO? FORCE)? (EDITIONABLE | EDITIONING | NONEDITIONABLE)* VIEW _if_not_exists? object <...>? (BEQUEATH ...)? AS query (WITH (READ ONLY | CHECK OPTION) (CONSTRAINT name)?)? | CREATE MATERIALIZED VIEW object (..( AS ))? AS query
create_index = CREATE (UNIQUE | BITMAP)? INDEX _if_not_exists? object ON (object alias? <...> | CLUSTER object) ...
create_function = CREATE _or_replace? (EDITIONABLE | NONEDITIONABLE)? FUNCTION object <...>? RETURN type ..( IS | AS ) (IS | AS) ...
create_procedure = CREATE _or_replace? (EDITIONABLE | NONEDITIONABLE)? PROCEDURE object <...>? (AUTHID (CURRENT_USER | DEFINER))? (IS | AS) ...
create_package = CREATE _or_replace? (EDITIONABLE | NONEDITIONABLE)? PACKAGE BODY? object (AUTHID (CURRENT_USER | DEFINER))? (IS | AS) ...
create_trigger = CREATE _or_replace? (EDITIONABLE | NONEDITIONABLE)? TRIGGER object (BEFORE | AFTER | INSTEAD OF | FOR) ..( ON ) ON any ...
create_type = CREATE _or_replace? TYPE BODY? object (AS | IS | UNDER) ...
create_synonym = CREATE _or_replace? PUBLIC? SYNONYM object FOR object any? name? | DROP PUBLIC? SYNONYM _if_exists? object FORCE?
create_other = CREATE _or_replace? (DIRECTORY | PROFILE | TABLESPACE | CLUSTER | CONTEXT | BIGFILE TABLESPACE | PUBLIC? DATABASE LINK) any ...
_block = DECLARE ... | BEGIN ... | END name? | IF expr THEN ... | LOOP ... | FOR ... | WHILE ... | RETURN expr? | EXCEPTION ... | NULL | name ":=" expr | object <...>?
insert += INSERT (ALL | FIRST) ... | INSERT INTO object alias? _names? _insert_source
delete = DELETE FROM? object alias? where? (RETURNING ..( INTO ) INTO ...)?
update = UPDATE object alias? SET assignment % "," where? (RETURNING ..( INTO ) INTO ...)?
prompt = (PROMPT | SPOOL | WHENEVER | SHOW | EXIT | UNDEFINE | DEFINE) ...
execute = (EXECUTE | EXEC) (IMMEDIATE expr (INTO ...)? (USING ...)? | object ...)
purge = PURGE ((TABLE | INDEX) object | RECYCLEBIN | TABLESPACE name)
flashback = FLASHBACK (TABLE | DATABASE) ...
rename = RENAME object TO object
lock = LOCK TABLE object % "," IN ..( MODE ) MODE (NOWAIT | WAIT number)?
alter_many = ALTER (SESSION | SYSTEM | INDEX | VIEW | PROCEDURE | FUNCTION | PACKAGE | TRIGGER | TYPE | USER | ROLE | DATABASE | TABLESPACE | MATERIALIZED VIEW | PROFILE) any ...
drop_many = DROP (PACKAGE BODY? | PROCEDURE | DIRECTORY | MATERIALIZED VIEW | PROFILE | TABLESPACE | DATABASE LINK | CONTEXT | CLUSTER) _if_exists? object ...
alter_action += (ADD | MODIFY) <(column_definition | table_constraint | name column_constraint+) % ","> | (ENABLE | DISABLE) (CONSTRAINT name | PRIMARY KEY | ALL TRIGGERS) | MODIFY name column_constraint+ | (ADD | DROP | TRUNCATE | SPLIT | MERGE | EXCHANGE | MOVE) PARTITION ... | DROP <name % ","> | SET UNUSED ... | MOVE ...
create_user = CREATE USER name IDENTIFIED (BY (name | string) | EXTERNALLY | GLOBALLY ...) ...
'''

GRAMMARS["redshift"] = r'''
_statement += rls | analyse | abort | unload | create_external | create_library | create_datashare | create_group | append | cancel | close
table_option += (DISTSTYLE (AUTO | EVEN | KEY | ALL) | DISTKEY <name> | (COMPOUND | INTERLEAVED)? SORTKEY (<...> | AUTO) | SORTKEY AUTO | BACKUP (YES | NO) | ENCODE AUTO)
column_constraint += ENCODE word | DISTKEY | SORTKEY | IDENTITY <...>? | GENERATED BY DEFAULT AS IDENTITY <...> | COLLATE (CASE_SENSITIVE | CASE_INSENSITIVE)
create_table = CREATE _table_kind? TABLE _if_not_exists? object (<table_element %? ","> | _names)? table_option* (AS? (query | <query>))?
create_view = CREATE _or_replace? VIEW object _names? AS query (WITH NO SCHEMA BINDING)?
create_materialized_view = CREATE MATERIALIZED VIEW object (BACKUP (YES | NO))? table_option* (AUTO REFRESH (YES | NO))? AS query
copy = COPY object _names? FROM (string | object) ...
rls = (CREATE | ATTACH | DETACH | DROP | ALTER) (RLS | MASKING) POLICY any ...
analyse = ANALYSE ...
abort = ABORT (WORK | TRANSACTION)?
access += (GRANT | REVOKE) ..( TO | FROM ) (TO | FROM) ...
create_schema += CREATE SCHEMA _if_not_exists? name (AUTHORIZATION name)? QUOTA ...
create_model = CREATE MODEL object FROM any ...
transaction += BEGIN (WORK | TRANSACTION) ISOLATION LEVEL word (READ (ONLY | WRITE))?
unload = UNLOAD <string | query> TO string ...
create_external = CREATE _or_replace? EXTERNAL (TABLE object ... | SCHEMA _if_not_exists? name FROM ... | FUNCTION object ...)
create_library = CREATE _or_replace? LIBRARY name LANGUAGE name FROM string ... | DROP LIBRARY name
create_datashare = (CREATE | ALTER | DROP | DESC) DATASHARE name ...
create_group = (CREATE | ALTER | DROP) GROUP name ...
create_user = CREATE USER name WITH? PASSWORD (string | DISABLE) ...
append = ALTER TABLE object APPEND FROM object (IGNOREEXTRA | FILLTARGET)?
alter_action += ALTER (DISTKEY name | DISTSTYLE word DISTKEY? name? | (COMPOUND)? SORTKEY (<...> | AUTO | NONE) | ENCODE AUTO | COLUMN name (ENCODE word | TYPE type))
cancel = CANCEL number string?
close = CLOSE name
analyze += ANALYZE COMPRESSION ...
vacuum += VACUUM (FULL | SORT ONLY | DELETE ONLY | REINDEX | RECLUSTER)? object? (TO number PERCENT)? BOOST?
show += SHOW (TABLE | VIEW | PROCEDURE | EXTERNAL TABLE | DATABASES | SCHEMAS | COLUMNS | DATASHARES) ...
use += USE object
'''

GRAMMARS["snowflake"] = r'''
_statement += copy_into | create_stage | create_file_format | create_stream | create_task | create_pipe | create_warehouse | create_procedure | create_other | alter_many | drop_many | show | _files | unset | undrop | execute | _scripting | create_stage | create_tag
_copy = COPY GRANTS
access += GRANT !ON ..( TO ) TO grantee % "," ... | REVOKE !ON ..( FROM ) FROM grantee % "," ...
transaction += START TRANSACTION NAME name
alter_sequence += ALTER SEQUENCE _if_exists? object UNSET COMMENT
_table_kind += TRANSIENT | HYBRID | DYNAMIC | ICEBERG | EVENT
create_role = CREATE _or_replace? ROLE _if_not_exists? name table_option*
truncate = TRUNCATE TABLE? _if_exists? object
explain = EXPLAIN (USING (TABULAR | JSON | TEXT))? (query | _statement)
create_table = CREATE _or_replace? _table_kind? TABLE _if_not_exists? object (CLUSTER BY LINEAR? <...>)? (CLONE object time_travel? | LIKE object | USING TEMPLATE <...> | <table_element %? ",">)? table_option* (AS query)?
time_travel = (AT | BEFORE) <...>
column_constraint += WITH? (MASKING POLICY object (USING <...>)? | TAG <...> | PROJECTION POLICY object) | AUTOINCREMENT (<...> | START number INCREMENT number)? (NO? ORDER | NOORDER)? | IDENTITY (<...> | START number INCREMENT number)? | COLLATE string | AS <expr> | NOT? ENFORCED | NOVALIDATE | RELY
table_option += CLUSTER BY (LINEAR)? <...> | _copy | ","? (word "=" (value | <...>)) | WITH? (ROW ACCESS POLICY object ON <...> | TAG <...> | AGGREGATION POLICY object)
create_view = CREATE _or_replace? SECURE? (LOCAL | GLOBAL)? (TEMP | TEMPORARY | VOLATILE)? RECURSIVE? MATERIALIZED? VIEW _if_not_exists? object (<(name column_constraint* (COMMENT string)?) % ",">)? table_option* (COMMENT "="? string)? AS query
create_schema = CREATE _or_replace? TRANSIENT? SCHEMA _if_not_exists? object (CLONE object time_travel?)? (WITH MANAGED ACCESS)? table_option*
create_database = CREATE _or_replace? TRANSIENT? DATABASE _if_not_exists? object (CLONE object time_travel? | FROM SHARE object)? table_option*
create_stage = CREATE _or_replace? (TEMP | TEMPORARY)? STAGE _if_not_exists? object table_option*
create_file_format = CREATE _or_replace? (TEMP | TEMPORARY | VOLATILE)? FILE FORMAT _if_not_exists? object table_option*
create_stream = CREATE _or_replace? STREAM _if_not_exists? object CLONE object | CREATE _or_replace? STREAM _if_not_exists? object _copy? ON (TABLE | VIEW | STAGE | EXTERNAL TABLE | DYNAMIC TABLE) object time_travel? table_option*
create_task = CREATE _or_replace? TASK _if_not_exists? object table_option* (AFTER object % ",")? (WHEN expr)? AS (query | _statement | ...)
create_pipe = CREATE _or_replace? PIPE _if_not_exists? object table_option* AS copy_into
create_warehouse = CREATE _or_replace? WAREHOUSE _if_not_exists? object WITH? table_option*
create_tag = CREATE _or_replace? (TAG | MASKING POLICY | ROW ACCESS POLICY | NETWORK POLICY | SESSION POLICY | PASSWORD POLICY | RESOURCE MONITOR | ALERT | SHARE | CONNECTION | INTEGRATION | (API | NOTIFICATION | SECURITY | STORAGE | EXTERNAL ACCESS) INTEGRATION | NETWORK RULE | SECRET | STREAMLIT | CORTEX SEARCH SERVICE) _if_not_exists? object ...
create_other = CREATE _or_replace? EXTERNAL (TABLE _if_not_exists? object ... | FUNCTION object ... | VOLUME object ...)
create_function = CREATE _or_replace? (TEMP | TEMPORARY)? SECURE? FUNCTION _if_not_exists? object <...> _copy? RETURNS (TABLE <...> | type) (NOT? NULL)? function_part+
create_procedure = CREATE _or_replace? SECURE? PROCEDURE _if_not_exists? object <...> _copy? RETURNS (TABLE <...>? | type) (NOT NULL)? function_part+
function_part += CALLED ON NULL INPUT | RETURNS NULL ON NULL INPUT | MEMOIZABLE | (RUNTIME_VERSION | HANDLER | TARGET_PATH | COMMENT) "=" string | (IMPORTS | PACKAGES | EXTERNAL_ACCESS_INTEGRATIONS | SECRETS) "=" <...> | EXECUTE AS (CALLER | OWNER) | AS (DECLARE | BEGIN) ...
create_user = CREATE _or_replace? USER _if_not_exists? name table_option*
copy_into = COPY INTO stage_or_table (<...>)? (FROM (<query> | stage_or_table))? ((FILES | PATTERN | FILE_FORMAT | VALIDATION_MODE | HEADER | PARTITION) ("=" (value | <...>) | BY expr) | table_option)*
stage_or_table = "@" ..( FROM | FILE_FORMAT | FILES | PATTERN | "(" | ")" ) | "@" ... | string | object
insert = INSERT OVERWRITE? INTO object _names? _insert_source | INSERT OVERWRITE? (ALL | FIRST) ...
merge_match = WHEN NOT? MATCHED (AND expr)? THEN _merge_action
alter_many = ALTER (WAREHOUSE | SESSION | USER | ROLE | ACCOUNT | DATABASE | SCHEMA | VIEW | STAGE | STREAM | TASK | PIPE | FUNCTION | PROCEDURE | FILE FORMAT | MATERIALIZED VIEW | EXTERNAL TABLE | DYNAMIC TABLE | SHARE | MASKING POLICY | TAG | NETWORK POLICY | (API | NOTIFICATION | SECURITY | STORAGE)? INTEGRATION | RESOURCE MONITOR | ALERT | ICEBERG TABLE | ROW ACCESS POLICY) any ...
alter_action += SWAP WITH object | RECLUSTER ... | (MODIFY | ALTER)? COLUMN? name (DROP DEFAULT | SET DEFAULT expr | (SET | DROP) NOT NULL | SET DATA TYPE type) | DROP CONSTRAINT name ... | CLUSTER BY <...> | DROP CLUSTERING KEY | (SUSPEND | RESUME) RECLUSTER | SET (TAG ... | table_option+) | UNSET ... | (ADD | DROP) (ROW ACCESS POLICY ... | SEARCH OPTIMIZATION ...) | (ALTER | MODIFY) COLUMN? <...> | (ALTER | MODIFY) COLUMN? name ((SET | UNSET) (MASKING POLICY | TAG) ... | COMMENT string | SET DATA TYPE type | TYPE? type) | ADD COLUMN? _if_not_exists? column_definition ("," column_definition)*
drop_many = DROP ((API | NOTIFICATION | SECURITY | STORAGE) INTEGRATION | MANAGED ACCOUNT | WAREHOUSE | STAGE | STREAM | TASK | PIPE | FILE FORMAT | PROCEDURE | MATERIALIZED VIEW | EXTERNAL TABLE | DYNAMIC TABLE | SHARE | TAG | (MASKING | NETWORK | SESSION | PASSWORD | ROW ACCESS) POLICY | INTEGRATION | RESOURCE MONITOR | CONNECTION | ALERT | ICEBERG TABLE | STREAMLIT) _if_exists? object (<...>)? _cascade?
show = SHOW ...
_files = (PUT | GET | LIST | LS | REMOVE | RM) ...
unset = UNSET (name % "," | _names)
undrop = UNDROP (TABLE | SCHEMA | DATABASE | TAG) object
use = USE (ROLE | WAREHOUSE | DATABASE | SCHEMA | SECONDARY ROLES)? (object | ALL | NONE)
execute = EXECUTE (IMMEDIATE ... | TASK object | ALERT object)
set_statement = SET (name | _names) "=" expr
describe = (DESCRIBE | DESC) any ...
_scripting = DECLARE ... | BEGIN ... | END | LET ... | name ":" "=" ... | RETURN ... | IF <expr> THEN ... | FOR ... | WHILE ... | OPEN name ... | CLOSE name | FETCH name INTO name % "," | BREAK | CONTINUE | RAISE name
'''

GRAMMARS["sqlite"] = r'''
_statement += pragma | attach | vacuum | reindex | analyze | replace | create_virtual
create_table = CREATE (TEMP | TEMPORARY)? TABLE _if_not_exists? object (<table_element % "," table_constraint*> | AS query) table_option*
column_definition = name type? column_constraint*
column_constraint += PRIMARY KEY (ASC | DESC)? _on_conflict? AUTOINCREMENT? | (NOT NULL | UNIQUE) _on_conflict | AS <expr> (STORED | VIRTUAL)? | DEFAULT <expr>
_on_conflict = ON CONFLICT (ROLLBACK | ABORT | FAIL | IGNORE | REPLACE)
table_option += ","? (WITHOUT ROWID | STRICT)
insert = INSERT (OR (REPLACE | ROLLBACK | ABORT | FAIL | IGNORE))? INTO object alias? _names? _insert_source (ON CONFLICT (<...> where?)? DO (NOTHING | UPDATE SET assignment % "," where?))* returning?
replace = REPLACE INTO object _names? _insert_source
update = UPDATE (OR (REPLACE | ROLLBACK | ABORT | FAIL | IGNORE))? object alias? SET assignment % "," (FROM (..( WHERE | RETURNING ) | ...))? where? returning?
create_trigger = CREATE (TEMP | TEMPORARY)? TRIGGER _if_not_exists? object (BEFORE | AFTER | INSTEAD OF)? trigger_event ON object (FOR EACH ROW)? (WHEN expr)? BEGIN ...
create_virtual = CREATE VIRTUAL TABLE _if_not_exists? object USING name <...>?
pragma = PRAGMA object ("=" (value | ON | OFF) | <...>)?
attach = ATTACH DATABASE? value AS name | DETACH DATABASE? name
vacuum = VACUUM name? (INTO value)?
reindex = REINDEX object?
analyze = ANALYZE object?
explain = EXPLAIN (QUERY PLAN)? (query | _statement)
transaction = (BEGIN (DEFERRED | IMMEDIATE | EXCLUSIVE)? | COMMIT | END | ROLLBACK) TRANSACTION? (TO SAVEPOINT? name)? | SAVEPOINT name | RELEASE SAVEPOINT? name
alter_action = RENAME (TO object | COLUMN? name TO name) | ADD COLUMN? column_definition | DROP COLUMN? name
'''

GRAMMARS["starrocks"] = r'''
_statement += create_routine_load | routine_load | submit_task | create_resource | create_catalog | refresh | create_materialized_view | backup
table_option += (DUPLICATE | AGGREGATE | UNIQUE | PRIMARY) KEY <...> | DISTRIBUTED BY (HASH <...> | RANDOM) (BUCKETS (number | AUTO))? | PARTITION BY (RANGE | LIST)? <...> <...>? | PARTITION BY (expr % ",") | ORDER BY <...> | PROPERTIES <...> | ROLLUP <...>
column_constraint += (SUM | MAX | MIN | REPLACE | REPLACE_IF_NOT_NULL | HLL_UNION | BITMAP_UNION) | AS expr
create_materialized_view = CREATE MATERIALIZED VIEW _if_not_exists? object _names? (COMMENT string)? (table_option | REFRESH (ASYNC | MANUAL | IMMEDIATE | DEFERRED)+ (START <...>)? (EVERY <...>)?)* AS query
refresh = REFRESH (EXTERNAL TABLE object ... | MATERIALIZED VIEW object ...)
create_routine_load = CREATE ROUTINE LOAD object ON object ...
routine_load = (PAUSE | RESUME | STOP | ALTER) ROUTINE LOAD ...
submit_task = SUBMIT TASK name? ... | DROP TASK name
create_resource = CREATE EXTERNAL? (RESOURCE | REPOSITORY) name ...
create_catalog = CREATE EXTERNAL CATALOG name (COMMENT string)? PROPERTIES <...> | DROP CATALOG name
backup = (BACKUP | RESTORE) SNAPSHOT ... | CANCEL ...
'''

GRAMMARS["teradata"] = r'''
_statement += session_statement | collect_statistics | bteq | locking | create_macro | help | show | replace_view | rename | database
_teradata_kind = (MULTISET | SET)? (GLOBAL TEMPORARY | VOLATILE)? (TRACE)?
create_table = CREATE _teradata_kind TABLE object ("," table_word)* (<table_element %? ","> | AS (<query> | object) WITH NO? DATA (AND NO? (STATISTICS | STATS))?) table_option*
table_word = NO? (FALLBACK | BEFORE JOURNAL | AFTER JOURNAL | LOG) (PROTECTION)? | CHECKSUM "=" word | DEFAULT MERGEBLOCKRATIO | MAP "=" name | FREESPACE "=" number
table_option += ","? (UNIQUE? PRIMARY INDEX name? <...> | NO PRIMARY INDEX | PARTITION BY (<...> | expr) | UNIQUE? INDEX name? <...> | ON COMMIT (PRESERVE | DELETE) ROWS)
column_constraint += (NOT)? CASESPECIFIC | CHARACTER SET word | FORMAT string | TITLE string | COMPRESS (<...> | value)? | UPPERCASE | INLINE LENGTH number | NAMED name
replace_view = REPLACE (VIEW | RECURSIVE VIEW | MACRO | PROCEDURE | FUNCTION) object any ...
create_macro = CREATE MACRO object <...>? AS <...>
session_statement = (SS | SET SESSION) ...
collect_statistics = COLLECT (STATISTICS | STATS | STAT | SUMMARY (STATISTICS | STATS)) ... | DROP (STATISTICS | STATS) ...
bteq = "." word ...
locking = LOCKING (TABLE | ROW | VIEW | DATABASE)? object? (FOR | IN) word MODE? NOWAIT? (query | _statement | ...)
help = HELP ...
show = SHOW word object
rename = RENAME (TABLE | VIEW | MACRO) object (TO | AS) object
database = DATABASE object
insert += (INSERT | INS) INTO? object _names? _insert_source | (INSERT | INS) INTO? object <expr % ",">
update += (UPDATE | UPD) object (FROM ..( SET ))? SET assignment % "," (ALL | where)? (ELSE INSERT ...)?
delete = (DELETE | DEL) FROM? object alias? (ALL | where)?
set_statement += SET QUERY_BAND "=" (string | NONE) UPDATE? FOR (SESSION | TRANSACTION) VOLATILE? | SET SESSION ... | SET ROLE ... | SET TIME ZONE ...
transaction += (BT | ET | BEGIN TRANSACTION | END TRANSACTION | ABORT)
'''

GRAMMARS["trino"] = r'''
_statement += show | prepare | execute | deallocate | analyze | create_materialized_view | refresh | _sessions | create_catalog
create_table = CREATE _or_replace? TABLE _if_not_exists? object (<table_element %? ",">)? table_option* (AS (query | <query>) (WITH NO? DATA)?)?
table_option += WITH <...>
column_constraint += WITH <...>
create_view = CREATE _or_replace? VIEW object (COMMENT string)? (SECURITY (DEFINER | INVOKER))? AS query
create_materialized_view = CREATE _or_replace? MATERIALIZED VIEW _if_not_exists? object (GRACE PERIOD expr | COMMENT string | WITH <...>)* AS query
refresh = REFRESH MATERIALIZED VIEW object
create_schema = CREATE SCHEMA _if_not_exists? object (AUTHORIZATION grantee)? (WITH <...>)?
create_catalog = CREATE CATALOG _if_not_exists? name USING name (COMMENT string)? (WITH <...>)? | DROP CATALOG _if_exists? name
alter_action += EXECUTE name <...>? where? | SET (PROPERTIES (name "=" value) % "," | AUTHORIZATION grantee)
show = SHOW (CREATE (TABLE | VIEW | SCHEMA | MATERIALIZED VIEW | FUNCTION) object | STATS FOR (object | <query>) | (TABLES | SCHEMAS | CATALOGS | FUNCTIONS | SESSION | ROLES | CURRENT ROLES | ROLE GRANTS | GRANTS | COLUMNS | BRANCHES) ...)
prepare = PREPARE name FROM (query | _statement)
execute = EXECUTE (name (USING value % ",")? | IMMEDIATE string (USING value % ",")?)
deallocate = DEALLOCATE PREPARE name
describe = (DESCRIBE | DESC) (INPUT | OUTPUT)? object
analyze = ANALYZE object (WITH <...>)?
_sessions = SET (SESSION object "=" expr | ROLE (name | ALL | NONE) (IN name)? | PATH object % "," | TIME ZONE (LOCAL | expr) | SESSION AUTHORIZATION (name | string)) | RESET SESSION (object | AUTHORIZATION)
explain = EXPLAIN ANALYZE? VERBOSE? (<...>)? (query | _statement)
merge = MERGE INTO object alias? USING merge_source ON expr merge_match+
transaction += START TRANSACTION (ISOLATION LEVEL word word? | READ (ONLY | WRITE)) % ","
'''

GRAMMARS["tsql"] = r'''
_statement += copy_into | declare | _flow | print | execute | create_procedure | create_type | go | raiserror | throw | waitfor | create_statistics | update_statistics | create_partition | alter_many | drop_many | bulk_insert | reconfigure | dbcc | create_synonym | create_login | cursor | kill | rename | backup | enable_trigger | disable_trigger
_as = AS
create_table = CREATE TABLE object (<table_element %? ","> | AS query)? table_option* (AS query)?
table_element += (INDEX name UNIQUE? (CLUSTERED | NONCLUSTERED)? COLUMNSTORE? <...>?) | PERIOD FOR SYSTEM_TIME <...>
column_definition = name (type | AS expr PERSISTED?) column_constraint*
column_constraint += IDENTITY <...>? | (NOT FOR REPLICATION) | ROWGUIDCOL | SPARSE | MASKED WITH <...> | (CONSTRAINT name)? (PRIMARY KEY | UNIQUE) (CLUSTERED | NONCLUSTERED) | GENERATED ALWAYS AS ROW (START | END) HIDDEN? | COLLATE name | ENCRYPTED WITH <...> | CONSTRAINT name DEFAULT value | PERSISTED
table_constraint += (CONSTRAINT name)? (PRIMARY KEY | UNIQUE) (CLUSTERED | NONCLUSTERED)? <...> (WITH <...>)? (ON name <...>?)? | (CONSTRAINT name)? DEFAULT value FOR name
table_option += ON name <...>? | TEXTIMAGE_ON name | WITH <...>
create_view = CREATE (OR ALTER)? VIEW object _names? (WITH name % ",")? AS query (WITH CHECK OPTION)?
create_index = CREATE UNIQUE? (CLUSTERED | NONCLUSTERED)? (COLUMNSTORE | XML | SPATIAL)? INDEX name ON object <...>? (INCLUDE <...>)? where? (WITH <...>)? (ON name <...>?)?
drop_index = DROP INDEX _if_exists? (object (ON object)?) % "," (WITH <...>)?
create_function = CREATE (OR ALTER)? FUNCTION object <...> RETURNS any ...
create_procedure = (CREATE (OR ALTER)? | ALTER) (PROCEDURE | PROC) object (..( AS ))? AS ...
create_trigger = CREATE (OR ALTER)? TRIGGER object ON (object | DATABASE | ALL SERVER) (WITH ..( FOR | AFTER | INSTEAD ))? (FOR | AFTER | INSTEAD OF) word % "," (NOT FOR REPLICATION)? AS ...
create_type = CREATE TYPE object (FROM type (NOT? NULL)? | AS TABLE <table_element %? ",">)
create_synonym = CREATE SYNONYM object FOR object | DROP SYNONYM _if_exists? object
create_schema = CREATE SCHEMA object (AUTHORIZATION name)?
create_login = CREATE (LOGIN | CREDENTIAL | CERTIFICATE | MASTER KEY | SYMMETRIC KEY | SECURITY POLICY | EXTERNAL (DATA SOURCE | FILE FORMAT | TABLE)) any ...
create_user = CREATE USER name ((FOR | FROM) LOGIN name | WITHOUT LOGIN | FROM EXTERNAL PROVIDER)? (WITH ...)?
create_statistics = CREATE STATISTICS name ON object <...> ...
update_statistics = UPDATE STATISTICS object ...
create_partition = (CREATE | ALTER) PARTITION (FUNCTION | SCHEME) name ...
insert = INSERT (TOP <...> PERCENT?)? INTO? object _hint? _names? output? (_insert_source | execute) (OPTION <...>)?
_hint = WITH <...>
output = OUTPUT ..( INTO | VALUES | SELECT | FROM | WHERE | EXEC | EXECUTE ) (INTO object _names?)?
update = UPDATE (TOP <...> PERCENT?)? object _hint? SET tsql_assignment % "," output? (FROM (..( WHERE | OPTION ) | ...))? where? (OPTION <...>)?
tsql_assignment = object ("=" | "+=" | "-=" | "*=" | "/=") (DEFAULT | expr)
delete = DELETE (TOP <...> PERCENT?)? FROM? object _hint? alias? output? (FROM (..( WHERE | OPTION ) | ...))? where? (OPTION <...>)?
merge = MERGE (TOP <...> PERCENT?)? INTO? object _hint? alias? USING merge_source ON expr merge_match+ (OUTPUT ...)? (OPTION <...>)?
merge_insert = INSERT _names? values | INSERT _names? DEFAULT VALUES
truncate = TRUNCATE TABLE object (WITH <...>)?
declare = DECLARE (any AS? (TABLE <table_element %? ","> | CURSOR ... | type) ("=" expr)?) % "," | DECLARE name (INSENSITIVE | SCROLL)* CURSOR ...
set_statement = SET any ("=" | "+=" | "-=") expr | SET word+ (ON | OFF | value) | SET TRANSACTION ISOLATION LEVEL word word? | SET IDENTITY_INSERT object (ON | OFF)
_flow = IF ... | ELSE ... | WHILE ... | BEGIN TRY? ... | BEGIN CATCH ... | END (TRY | CATCH | CONVERSATION)? | RETURN ... | BREAK | CONTINUE | GOTO name | name ":"
print = PRINT expr
execute = (EXEC | EXECUTE) (any "=")? (object ... | <...> ... | AS ...) | REVERT
go = GO number?
copy_into = COPY INTO object <...>? FROM string ...
raiserror = RAISERROR <...> (WITH name % ",")?
throw = THROW (value "," value "," value)?
waitfor = WAITFOR (DELAY | TIME) value
cursor = (OPEN | CLOSE | DEALLOCATE) GLOBAL? any | FETCH ...
bulk_insert = BULK INSERT object FROM string (WITH <...>)?
reconfigure = RECONFIGURE (WITH OVERRIDE)?
dbcc = DBCC word ...
kill = KILL value
rename = RENAME (OBJECT | DATABASE) ("::")? object TO name
backup = (BACKUP | RESTORE) (DATABASE | LOG) ...
enable_trigger = (ENABLE | DISABLE) TRIGGER (name % "," | ALL) ON any ...
disable_trigger = DISABLE TRIGGER any ...
transaction += (BEGIN | COMMIT | ROLLBACK | SAVE) (TRAN | TRANSACTION | WORK)? any? (WITH MARK string?)?
alter_many = ALTER (DATABASE | INDEX | LOGIN | USER | ROLE | SCHEMA | VIEW | FUNCTION | TRIGGER | AUTHORIZATION | SERVER | SECURITY POLICY) any ...
alter_table = ALTER TABLE object (WITH (CHECK | NOCHECK))? alter_action % ","
alter_action += ADD (column_definition | table_constraint) ("," (column_definition | table_constraint))* | ALTER COLUMN name (type (COLLATE name)? (NOT? NULL)? | (ADD | DROP) word) | (CHECK | NOCHECK) CONSTRAINT (ALL | name) | (ENABLE | DISABLE) TRIGGER (ALL | name) | SWITCH ... | REBUILD ... | SET <...>
drop_many = DROP (PROCEDURE | PROC | TYPE | STATISTICS | LOGIN | MASTER KEY | PARTITION (FUNCTION | SCHEME) | EXTERNAL (TABLE | DATA SOURCE | FILE FORMAT) | SECURITY POLICY) _if_exists? object % ","
use = USE object
access += DENY _grant (ON _grant_object)? TO grantee % "," _cascade? | GRANT word+ (ON ("::" | any "::")? object)? TO grantee % ","
'''
