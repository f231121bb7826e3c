"""Errors of the graph store."""


class GraphError(Exception):
    """Base of all errors below."""


class StorageError(GraphError):
    pass


class CodecError(GraphError):
    pass


class NodeNotFound(GraphError):
    pass


class EdgeNotFound(GraphError):
    pass


class LabelNotFound(GraphError):
    pass


class PropertyNotFound(GraphError):
    pass


class IndexNotFound(GraphError):
    pass


class VectorIndexNotFound(IndexNotFound):
    pass


class InvalidVectorDim(GraphError):
    pass


class DuplicateKey(GraphError):
    pass


class TransactionConflict(GraphError):
    pass


class InvalidConfig(GraphError):
    pass


class InvalidCursor(GraphError):
    pass
