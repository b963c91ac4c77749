"""Names that are never references or call targets of a file's own."""

GLOBALS = frozenset(
    (
        "String Number Boolean Object Array Symbol BigInt Date RegExp Error TypeError RangeError SyntaxError ReferenceError EvalError URIError Promise Map Set "
        "WeakMap WeakSet JSON Math Reflect Proxy Intl parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent encodeURI decodeURI URL "
        "URLSearchParams FormData Blob File Headers Request Response AbortController AbortSignal TextEncoder TextDecoder console str int float bool list dict "
        "set tuple bytes len range enumerate zip map filter sum min max print open isinstance type super sorted reversed any all abs round next iter hash id "
        "repr callable getattr setattr hasattr delattr vars dir"
    ).split()
)
TYPE_CONTAINERS = frozenset(
    (
        "list dict set tuple frozenset type List Dict Set Tuple FrozenSet Type Optional Union Sequence Iterable Mapping MutableMapping Iterator Callable Awaitable "
        "AsyncIterable AsyncIterator Coroutine Generator AsyncGenerator ContextManager AsyncContextManager Annotated ClassVar Final Literal Concatenate ParamSpec "
        "TypeVar None Ellipsis"
    ).split()
)
ANNOTATION_NOISE = frozenset(
    "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock patch sentinel".split()
)
