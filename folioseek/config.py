"""Settings handed to operators; plain values, no session state."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkSettings:
    """Token windows of ``size`` that share ``overlap`` tokens."""

    size: int = 512
    overlap: int = 50

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")

    @property
    def step(self) -> int:
        return self.size - self.overlap


@dataclass(frozen=True)
class ModelSettings:
    """What depends on the answering model."""

    model_id: str
    embedding_model: str
    template: str
    options: dict[str, str] = field(default_factory=dict)


# Prompt templates. The hosted template leaves out the name of
# the company that built the assistant.
HOSTED_TEMPLATE = (
    "You are a helpful assistant, you are good at helping to answer a question based on the context provided, "
    "the context is a document. If the context does not provide enough relevant information to determine the "
    "answer, just say I don't know. If the context is irrelevant to the question, just say I don't know. If you "
    "did not find a good answer from the context, just say I don't know. If the query doesn't form a complete "
    "question, just say I don't know. If there is a good answer from the context, try to summarize the context "
    "to answer the question.\n"
    "  Given the context: {context}. Answer the question {question}."
)
IM_TEMPLATE = (
    "<|im_start|>system\n-ou are a assistant built to answer policy related questions based on the context "
    "provided, the context is a document and use no other information.If the context does not provide enough "
    "relevant information to determine the answer, just say I don't know. If the context is irrelevant to the "
    "question, just say I don't know. If the query doesn't form a complete question, just say I don't know.Only "
    "answer the question asked and do not repeat the question \n<|im_end|>\n<|im_start|>user\n Given the "
    "context: {context}. Answer the question {question} <|im_end|><|im_start|>assistant"
)
INST_SYSTEM = (
    "<s><<SYS>>\n"
    "  You are a assistant built to answer policy related questions based on the context provided, the context is "
    "a document and use no other information.If the context does not provide enough relevant information to "
    "determine the answer, just say I don't know. If the context is irrelevant to the question, just say I don't "
    "know. If the query doesn't form a complete question, just say I don't know.Only answer the question asked "
    "and do not repeat the question\n"
)
INST_TEMPLATE = INST_SYSTEM + (
    "  <</SYS>>[INST] Given the context: {context}. Answer the question {question} ?\n\n  [/INST]"
)
INST_TEMPLATE_EXPLORATORY = INST_SYSTEM + (
    "  <</SYS>>[INST] Given the context: {context}.  Answer the question {question} ?\n [/INST]"
)

# Templates by name, for runs that do not take the one of their model.
TEMPLATES = {
    "hosted": HOSTED_TEMPLATE,
    "im": IM_TEMPLATE,
    "inst": INST_TEMPLATE,
    "inst-exploratory": INST_TEMPLATE_EXPLORATORY,
}

# Settings per model, keyed by the model's name without its owner.
MODELS = {
    settings.model_id: settings
    for settings in (
        ModelSettings(
            "openai",
            "text-embedding-ada-002",
            HOSTED_TEMPLATE,
            {"openai_chat_model": "gpt-3.5-turbo", "temperature": "0.15"},
        ),
        ModelSettings(
            "mpt-30b-chat",
            "BAAI/bge-large-en",
            IM_TEMPLATE,
            {"temperature": "0.1", "max_new_tokens": "256"},
        ),
        ModelSettings(
            "Llama-2-13b-chat-hf",
            "BAAI/bge-large-en",
            INST_TEMPLATE,
            {"temperature": "0.1", "max_new_tokens": "256"},
        ),
        ModelSettings(
            "Llama-2-70b-chat-hf",
            "BAAI/bge-large-en",
            INST_TEMPLATE,
            {"temperature": "0.1", "max_new_tokens": "256", "load_in_8bit": "True"},
        ),
    )
}

# Fixed value.
DEFAULT_MODEL = "Llama-2-13b-chat-hf"

# Retrieved chunks per question, and chunks per context.
DEFAULT_K = 10
CHUNKS_PER_CONTEXT = 3


def model_settings(model_id: str = DEFAULT_MODEL) -> ModelSettings:
    """Settings of a model, with or without the ``owner/`` before its name."""
    name = model_id.rsplit("/", 1)[-1]
    if name not in MODELS:
        raise KeyError(f"no settings for model {model_id!r}; known: {sorted(MODELS)}")
    return MODELS[name]
