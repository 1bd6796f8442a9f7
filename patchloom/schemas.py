"""Schemas of the nested records (DDL), so that no reader infers one."""

LINE = "struct<line: string, type: string, lineNo: int>"
ELEMENT = "struct<type: string, value: string>"
HUNK = f"struct<type: string, sourceChanges: array<{LINE}>, targetChanges: array<{LINE}>, sourceElements: array<{ELEMENT}>, targetElements: array<{ELEMENT}>>"
SOURCE = "struct<startLine: int, code: string>"
NODE = "struct<label: string, childCount: int>"
ACTION = f"struct<type: string, nodeType: string, parents: array<string>, srcNode: {NODE}, dstNode: {NODE}>"
VERDICT = "struct<status: string, error_lines: array<int>>"
REPAIR = (
    f"ID string, name string, bPath string, aPath string, bCommit string, aCommit string, aCommitTime long, bSource {SOURCE}, aSource {SOURCE}, "
    f"hunk {HUNK}, astActions array<{ACTION}>, refactorings array<string>, verdict {VERDICT}, trivial array<string>"
)
CHANGE = f"struct<bPath: string, aPath: string, name: string, is_test_source: boolean, hunks: array<{HUNK}>>"
CHANGE_SET = f"bCommit string, aCommit string, changes array<{CHANGE}>"
GRAPH_NODE = "struct<id: int, name: string, path: string, depth: int>"
CALL_GRAPHS = f"map<string, map<string, struct<root: {GRAPH_NODE}, nodes: array<{GRAPH_NODE}>, graph: map<string, array<int>>>>>"
ELEMENTS = "map<string, map<string, struct<types: array<string>, executables: array<string>>>>"
RENAMES = "map<string, array<struct<refactoringType: string, originalName: string, newName: string>>>"
VERDICTS = f"verdict {VERDICT}, id string, rank int, exec_time double"
PREDICTIONS = "ID string, target string, preds array<string>"
TEST_CLASSES = "b_path string, a_path string, b_commit string, a_commit string"
