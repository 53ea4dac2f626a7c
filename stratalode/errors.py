"""Every failure that a caller can tell apart; all derive from ``StoreError``."""


class StoreError(Exception):
    """Base of all errors of this library."""


def _make(name: str, doc: str) -> type[StoreError]:
    return type(name, (StoreError,), {"__doc__": doc, "__module__": __name__})


NotStorePath = _make("NotStorePath", "The path does not end in the store suffix.")
NotStore = _make("NotStore", "No store identity at the path.")
UnsupportedVersion = _make("UnsupportedVersion", "The store has another format version.")
DestinationExists = _make("DestinationExists", "The destination is there already.")
NameConflict = _make("NameConflict", "A source table has a reserved name.")
ObjectNotFound = _make("ObjectNotFound", "No such object.")
ObjectAlreadyExists = _make("ObjectAlreadyExists", "The object is there already.")
ObjectChunkNotFound = _make("ObjectChunkNotFound", "No such chunk.")
ObjectChunkHashMismatch = _make("ObjectChunkHashMismatch", "Chunk bytes do not have the given hash.")
ObjectCorrupt = _make("ObjectCorrupt", "Stored bytes or manifest rows are damaged.")
ObjectManifestInvalid = _make("ObjectManifestInvalid", "A given manifest is not contiguous, complete or true.")
ObjectRangeInvalid = _make("ObjectRangeInvalid", "The range starts beyond the object.")
ObjectTooLarge = _make("ObjectTooLarge", "The object is larger than a signed 64-bit size.")
ObjectTransactionActive = _make("ObjectTransactionActive", "Object writes need a handle without a transaction.")
ObjectWriterClosed = _make("ObjectWriterClosed", "The writer was finished or cancelled.")
BoundStoreExists = _make("BoundStoreExists", "A store of this role is bound already.")
BoundStoreNotFound = _make("BoundStoreNotFound", "No store of this role is bound.")
BoundStoreInvalid = _make("BoundStoreInvalid", "The bound store does not belong to this one.")
VectorCollectionExists = _make("VectorCollectionExists", "The collection is there already.")
VectorCollectionNotFound = _make("VectorCollectionNotFound", "No such collection.")
VectorNotFound = _make("VectorNotFound", "No such vector.")
VectorDimensionMismatch = _make("VectorDimensionMismatch", "The vector has another number of dimensions.")
VectorCorrupt = _make("VectorCorrupt", "A stored vector is damaged.")
VectorInvalid = _make("VectorInvalid", "An argument of a vector call is not allowed.")
GraphExists = _make("GraphExists", "The graph is there already.")
GraphNotFound = _make("GraphNotFound", "No such graph.")
GraphNodeNotFound = _make("GraphNodeNotFound", "No such node.")
GraphEdgeNotFound = _make("GraphEdgeNotFound", "No such edge.")
GraphInvalid = _make("GraphInvalid", "An argument of a graph call is not allowed.")
InvalidArgument = _make("InvalidArgument", "An argument is not allowed.")
Busy = _make("Busy", "Another writer committed first.")
Locked = _make("Locked", "A table is in use.")
Constraint = _make("Constraint", "A uniqueness or not-null rule would be broken.")
CantOpen = _make("CantOpen", "The store cannot be opened.")
Misuse = _make("Misuse", "The call does not fit the state of the handle.")
Interrupt = _make("Interrupt", "The call was interrupted.")
ReadOnly = _make("ReadOnly", "The handle is read-only.")
Corrupt = _make("Corrupt", "The store is damaged.")
ClosedHandle = _make("ClosedHandle", "The handle was closed.")
