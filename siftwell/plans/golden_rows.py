"""What the queries over the known repository must give; columns, types and rows."""

EXPECTED: dict[str, tuple] = {
    'python_symbols': (
        'path name qualified_name kind start_line end_line source_snippet',
        {'path': 'VARCHAR', 'name': 'VARCHAR', 'qualified_name': 'VARCHAR', 'kind': 'VARCHAR', 'start_line': 'INTEGER', 'end_line': 'INTEGER', 'source_snippet': 'VARCHAR'},
        [
            ('app/base.py', 'Base', 'Base', 'class', 1, 2, 'class Base:\n    pass\n'),
            ('app/service.py', 'Service', 'Service', 'class', 10, 18, 'class Service(Base):\n    """A service."""\n\n    async def run(self):\n        self.stop()\n        return h(os.path)\n\n    def stop(self):\n        pass\n'),
            ('app/service.py', 'run', 'Service.run', 'async_method', 13, 15, '    async def run(self):\n        self.stop()\n        return h(os.path)\n'),
            ('app/service.py', 'stop', 'Service.stop', 'method', 17, 18, '    def stop(self):\n        pass\n'),
            ('app/util.py', 'helper', 'helper', 'function', 1, 2, 'def helper(x):\n    return x\n'),
            ('tests/test_service.py', 'test_service', 'test_service', 'function', 4, 5, 'def test_service(client):\n    Service().run()\n'),
        ],
    ),
    'python_units': (
        'path kind start_line end_line symbol text',
        {'path': 'VARCHAR', 'kind': 'VARCHAR', 'start_line': 'INTEGER', 'end_line': 'INTEGER', 'symbol': 'VARCHAR', 'text': 'VARCHAR'},
        [
            ('README.md', 'documentation', 1, 3, None, '# Usage\nCall the helper.\n'),
            ('README.md', 'documentation', 4, 6, None, 'More\n----\ntext'),
            ('app/base.py', 'symbol', 1, 2, 'Base', 'class Base:\n    pass\n'),
            ('app/service.py', 'assignment', 6, 6, None, 'LIMIT = 3\n'),
            ('app/service.py', 'imports', 2, 4, None, 'import os\nfrom .base import Base\nfrom .util import helper as h\n'),
            ('app/service.py', 'module_code', 21, 21, None, 'print(LIMIT)\n'),
            ('app/service.py', 'module_docstring', 1, 1, None, '"""Service module."""\n'),
            ('app/service.py', 'symbol', 10, 18, 'Service', 'class Service(Base):\n    """A service."""\n\n    async def run(self):\n        self.stop()\n        return h(os.path)\n\n    def stop(self):\n        pass\n'),
            ('app/service.py', 'symbol', 13, 15, 'Service.run', '    async def run(self):\n        self.stop()\n        return h(os.path)\n'),
            ('app/service.py', 'symbol', 17, 18, 'Service.stop', '    def stop(self):\n        pass\n'),
            ('app/service.py', 'symbol_comment', 8, 9, 'Service', '# makes\n# things\n'),
            ('app/service.py', 'symbol_docstring', 11, 11, 'Service', '    """A service."""\n'),
            ('app/util.py', 'symbol', 1, 2, 'helper', 'def helper(x):\n    return x\n'),
            ('keep.tmp.py', 'assignment', 1, 1, None, 'y = 2\n'),
            ('pkg/data/kept.rst', 'documentation', 1, 3, None, 'Title\n=====\ntext'),
            ('tests/test_service.py', 'imports', 1, 1, None, 'from app.service import Service\n'),
            ('tests/test_service.py', 'symbol', 4, 5, 'test_service', 'def test_service(client):\n    Service().run()\n'),
        ],
    ),
    'graph_nodes': (
        'path kind qualified_name name start_line end_line symbol',
        {'path': 'VARCHAR', 'kind': 'VARCHAR', 'qualified_name': 'VARCHAR', 'name': 'VARCHAR', 'start_line': 'INTEGER', 'end_line': 'INTEGER', 'symbol': 'VARCHAR'},
        [
            ('app/__init__.py', 'file', 'app/__init__.py', '__init__.py', 1, 1, None),
            ('app/__init__.py', 'module', 'app', 'app', 1, 1, None),
            ('app/base.py', 'file', 'app/base.py', 'base.py', 1, 2, None),
            ('app/base.py', 'module', 'app.base', 'base', 1, 2, None),
            ('app/base.py', 'symbol', 'app.base.Base', 'Base', 1, 2, 'Base'),
            ('app/service.py', 'file', 'app/service.py', 'service.py', 1, 21, None),
            ('app/service.py', 'module', 'app.service', 'service', 1, 21, None),
            ('app/service.py', 'symbol', 'app.service.Service', 'Service', 10, 18, 'Service'),
            ('app/service.py', 'symbol', 'app.service.Service.run', 'run', 13, 15, 'Service.run'),
            ('app/service.py', 'symbol', 'app.service.Service.stop', 'stop', 17, 18, 'Service.stop'),
            ('app/util.py', 'file', 'app/util.py', 'util.py', 1, 2, None),
            ('app/util.py', 'module', 'app.util', 'util', 1, 2, None),
            ('app/util.py', 'symbol', 'app.util.helper', 'helper', 1, 2, 'helper'),
            ('keep.tmp.py', 'file', 'keep.tmp.py', 'keep.tmp.py', 1, 1, None),
            ('keep.tmp.py', 'module', 'keep.tmp', 'tmp', 1, 1, None),
            ('tests/test_service.py', 'module', 'tests.test_service', 'test_service', 1, 5, None),
            ('tests/test_service.py', 'test_file', 'tests/test_service.py', 'test_service.py', 1, 5, None),
            ('tests/test_service.py', 'test_symbol', 'tests.test_service.test_service', 'test_service', 4, 5, 'test_service'),
        ],
    ),
    'graph_facts': (
        'path ordinal kind source_reference target_reference start_line confidence target_kind hint hint_method evidence',
        {'path': 'VARCHAR', 'ordinal': 'INTEGER', 'kind': 'VARCHAR', 'source_reference': 'VARCHAR', 'target_reference': 'VARCHAR', 'start_line': 'INTEGER', 'confidence': 'DOUBLE', 'target_kind': 'VARCHAR', 'hint': 'VARCHAR', 'hint_method': 'VARCHAR', 'evidence': 'VARCHAR'},
        [
            ('app/service.py', 0, 'imports', 'app.service', 'os', 2, 1.0, 'module', 'os', 'explicitly_imported_module', 'import os'),
            ('app/service.py', 1, 'imports', 'app.service', 'app.base', 3, 1.0, 'module', 'app.base', 'explicitly_imported_module', 'from .base import Base'),
            ('app/service.py', 10, 'references', 'app.service.Service.run', 'os.path', 15, 0.7, 'symbol', 'os.path', 'explicitly_imported_module_member', 'os.path'),
            ('app/service.py', 11, 'calls', 'app.service', 'print', 21, 0.9, 'symbol', None, None, 'print'),
            ('app/service.py', 12, 'references', 'app.service', 'print', 21, 0.6, 'any', None, None, 'print'),
            ('app/service.py', 13, 'references', 'app.service', 'LIMIT', 21, 0.6, 'any', None, None, 'LIMIT'),
            ('app/service.py', 2, 'imports', 'app.service', 'Base', 3, 1.0, 'any', 'app.base.Base', 'explicitly_imported_symbol', 'from .base import Base'),
            ('app/service.py', 3, 'imports', 'app.service', 'app.util', 4, 1.0, 'module', 'app.util', 'explicitly_imported_module', 'from .util import helper as h'),
            ('app/service.py', 4, 'imports', 'app.service', 'helper', 4, 1.0, 'any', 'app.util.helper', 'explicitly_imported_symbol', 'from .util import helper as h'),
            ('app/service.py', 5, 'inherits', 'app.service.Service', 'Base', 10, 0.95, 'symbol', 'app.base.Base', 'explicitly_imported_symbol', 'Base'),
            ('app/service.py', 6, 'calls', 'app.service.Service.run', 'self.stop', 14, 0.9, 'symbol', 'app.service.Service.stop', 'same_scope_qualified', 'self.stop'),
            ('app/service.py', 7, 'references', 'app.service.Service.run', 'self.stop', 14, 0.7, 'symbol', 'app.service.Service.stop', 'same_scope_qualified', 'self.stop'),
            ('app/service.py', 8, 'calls', 'app.service.Service.run', 'h', 15, 0.9, 'symbol', 'app.util.helper', 'explicitly_imported_symbol', 'h'),
            ('app/service.py', 9, 'references', 'app.service.Service.run', 'h', 15, 0.6, 'any', 'app.util.helper', 'explicitly_imported_symbol', 'h'),
            ('app/util.py', 0, 'references', 'app.util.helper', 'x', 2, 0.6, 'any', None, None, 'x'),
            ('tests/test_service.py', 0, 'imports', 'tests.test_service', 'app.service', 1, 1.0, 'module', 'app.service', 'explicitly_imported_module', 'from app.service import Service'),
            ('tests/test_service.py', 1, 'tests', 'tests.test_service', 'app.service', 1, 0.7, 'module', None, None, 'from app.service import Service'),
            ('tests/test_service.py', 2, 'imports', 'tests.test_service', 'Service', 1, 1.0, 'any', 'app.service.Service', 'explicitly_imported_symbol', 'from app.service import Service'),
            ('tests/test_service.py', 3, 'tests', 'tests.test_service', 'Service', 1, 0.75, 'any', 'app.service.Service', 'explicitly_imported_symbol', 'from app.service import Service'),
            ('tests/test_service.py', 4, 'tests', 'tests.test_service.test_service', 'service', 4, 0.65, 'symbol', None, None, 'test_service'),
            ('tests/test_service.py', 5, 'tests', 'tests.test_service.test_service', 'client', 4, 0.55, 'symbol', None, None, 'client'),
        ],
    ),
    'diagnostics': (
        'path stage line',
        {'path': 'VARCHAR', 'stage': 'VARCHAR', 'line': 'INTEGER'},
        [
            ('bad.py', 'parse', 1),
        ],
    ),
    'index_tables': (
        'table_name n',
        {'table_name': 'VARCHAR', 'n': 'BIGINT'},
        [
            ('chunks', 17),
            ('document_sizes', 23),
            ('embeddings', 17),
            ('files', 8),
            ('graph_edges', 16),
            ('graph_facts', 21),
            ('graph_nodes', 19),
            ('graph_status', 21),
            ('symbols', 6),
        ],
    ),
    'index_report': (
        'what n',
        {'what': 'VARCHAR', 'n': 'BIGINT'},
        [
            ('added', 9),
            ('embedded', 17),
            ('errors', 1),
        ],
    ),
    'graph_edges': (
        'kind source_kind source_name target_kind target_name start_line method confidence',
        {'kind': 'VARCHAR', 'source_kind': 'VARCHAR', 'source_name': 'VARCHAR', 'target_kind': 'VARCHAR', 'target_name': 'VARCHAR', 'start_line': 'INTEGER', 'method': 'VARCHAR', 'confidence': 'DOUBLE'},
        [
            ('calls', 'symbol', 'app.service.Service.run', 'symbol', 'app.service.Service.stop', 14, 'same_scope_qualified', 0.9),
            ('calls', 'symbol', 'app.service.Service.run', 'symbol', 'app.util.helper', 15, 'explicitly_imported_symbol', 0.9),
            ('depends_on', 'file', 'app/service.py', 'file', 'app/base.py', 3, 'resolved_import', 1.0),
            ('depends_on', 'file', 'app/service.py', 'file', 'app/util.py', 4, 'resolved_import', 1.0),
            ('depends_on', 'test_file', 'tests/test_service.py', 'file', 'app/service.py', 1, 'resolved_import', 1.0),
            ('imports', 'module', 'app.service', 'module', 'app.base', 3, 'explicitly_imported_module', 1.0),
            ('imports', 'module', 'app.service', 'module', 'app.util', 4, 'explicitly_imported_module', 1.0),
            ('imports', 'module', 'app.service', 'symbol', 'app.base.Base', 3, 'explicitly_imported_symbol', 1.0),
            ('imports', 'module', 'app.service', 'symbol', 'app.util.helper', 4, 'explicitly_imported_symbol', 1.0),
            ('imports', 'module', 'tests.test_service', 'module', 'app.service', 1, 'explicitly_imported_module', 1.0),
            ('imports', 'module', 'tests.test_service', 'symbol', 'app.service.Service', 1, 'explicitly_imported_symbol', 1.0),
            ('inherits', 'symbol', 'app.service.Service', 'symbol', 'app.base.Base', 10, 'explicitly_imported_symbol', 0.95),
            ('references', 'symbol', 'app.service.Service.run', 'symbol', 'app.service.Service.stop', 14, 'same_scope_qualified', 0.7),
            ('references', 'symbol', 'app.service.Service.run', 'symbol', 'app.util.helper', 15, 'explicitly_imported_symbol', 0.6),
            ('tests', 'module', 'tests.test_service', 'module', 'app.service', 1, 'unique_repository_qualified_match', 0.63),
            ('tests', 'module', 'tests.test_service', 'symbol', 'app.service.Service', 1, 'explicitly_imported_symbol', 0.75),
        ],
    ),
    'fact_states': (
        'path status n',
        {'path': 'VARCHAR', 'status': 'VARCHAR', 'n': 'BIGINT'},
        [
            ('app/service.py', 'resolved', 9),
            ('app/service.py', 'unresolved', 5),
            ('app/util.py', 'unresolved', 1),
            ('tests/test_service.py', 'resolved', 4),
            ('tests/test_service.py', 'unresolved', 2),
        ],
    ),
    'chunk_rows': (
        'path start_line end_line kind name qualified_name dimension',
        {'path': 'VARCHAR', 'start_line': 'INTEGER', 'end_line': 'INTEGER', 'kind': 'VARCHAR', 'name': 'VARCHAR', 'qualified_name': 'VARCHAR', 'dimension': 'INTEGER'},
        [
            ('README.md', 1, 3, 'documentation', None, None, 64),
            ('README.md', 4, 6, 'documentation', None, None, 64),
            ('app/base.py', 1, 2, 'symbol', 'Base', 'Base', 64),
            ('app/service.py', 1, 1, 'module_docstring', None, None, 64),
            ('app/service.py', 10, 18, 'symbol', 'Service', 'Service', 64),
            ('app/service.py', 11, 11, 'symbol_docstring', 'Service', 'Service', 64),
            ('app/service.py', 13, 15, 'symbol', 'run', 'Service.run', 64),
            ('app/service.py', 17, 18, 'symbol', 'stop', 'Service.stop', 64),
            ('app/service.py', 2, 4, 'imports', None, None, 64),
            ('app/service.py', 21, 21, 'module_code', None, None, 64),
            ('app/service.py', 6, 6, 'assignment', None, None, 64),
            ('app/service.py', 8, 9, 'symbol_comment', 'Service', 'Service', 64),
            ('app/util.py', 1, 2, 'symbol', 'helper', 'helper', 64),
            ('keep.tmp.py', 1, 1, 'assignment', None, None, 64),
            ('pkg/data/kept.rst', 1, 3, 'documentation', None, None, 64),
            ('tests/test_service.py', 1, 1, 'imports', None, None, 64),
            ('tests/test_service.py', 4, 5, 'symbol', 'test_service', 'test_service', 64),
        ],
    ),
    'search_modes': (
        'query requested mode path qualified_name warnings',
        {'query': 'VARCHAR', 'requested': 'VARCHAR', 'mode': 'VARCHAR', 'path': 'VARCHAR', 'qualified_name': 'VARCHAR', 'warnings': 'BIGINT'},
        [
            ('Service', 'lexical', 'lexical', 'app/service.py', 'Service', 0),
            ('Service.stop', 'exact', 'exact', 'app/service.py', 'Service.stop', 0),
            ('app/util.py', 'lexical', 'lexical', 'app/util.py', 'helper', 0),
            ('helper', 'auto', 'exact', 'app/util.py', 'helper', 0),
            ('helpr', 'auto', 'fuzzy', 'app/util.py', 'helper', 0),
            ('how is a thing done', 'auto', 'semantic', None, None, 0),
            ('imports of Base', 'lexical', 'lexical', 'app/base.py', 'Base', 0),
            ('stop', 'fuzzy', 'fuzzy', 'app/service.py', 'Service.stop', 0),
        ],
    ),
    'graph_search': (
        'rank qualified_name score',
        {'rank': 'BIGINT', 'qualified_name': 'VARCHAR', 'score': 'DOUBLE'},
        [
            (1, 'helper', 1.0),
            (2, 'Service.run', 0.567),
            (3, 'app/service.py', 0.42),
        ],
    ),
    'index_life': (
        'step status changed files symbols',
        {'step': 'VARCHAR', 'status': 'VARCHAR', 'changed': 'VARCHAR', 'files': 'BIGINT', 'symbols': 'BIGINT'},
        [
            ('again', 'ready', '', 1, 2),
            ('before', 'missing', '', None, None),
            ('being written', 'indexing', '', None, None),
            ('broken', 'stale', 'changed: a.py', 1, 2),
            ('copied', '4', 'life-', 1, 2),
            ('edited', 'stale', 'changed: a.py, deleted: b.py', 2, 2),
            ('indexed', 'ready', '', 2, 2),
            ('removed', 'missing', '', None, None),
        ],
    ),
}
