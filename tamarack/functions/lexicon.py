"""Word lists of the profile ranking engine.

Fixed values: results depend on every entry, so these are stated as they are.
"""

SKILLS = {
    "Python": ("python",),
    "Machine Learning": ("machine learning", "ml"),
    "Deep Learning": ("deep learning",),
    "NLP": ("nlp", "natural language processing"),
    "LLM": ("llm", "llms", "large language model", "large language models"),
    "RAG": ("rag", "retrieval augmented generation"),
    "Embeddings": ("embedding", "embeddings", "sentence transformer"),
    "Vector Database": ("vector database", "vector databases", "vector db", "pinecone", "weaviate", "qdrant", "milvus", "faiss"),
    "Retrieval": ("retrieval", "retriever", "semantic search", "dense retrieval", "hybrid retrieval"),
    "Search": ("search", "search relevance", "search engine"),
    "Ranking": ("ranking", "ranker", "learning to rank", "ltr"),
    "Recommendation Systems": ("recommendation system", "recommendation systems", "recommender", "recommenders", "personalization"),
    "Information Retrieval": ("information retrieval", "ir system", "ir systems"),
    "NDCG": ("ndcg",),
    "MRR": ("mrr", "mean reciprocal rank"),
    "MAP": ("mean average precision", "map@", "map"),
    "A/B Testing": ("a/b testing", "a/b test", "ab testing", "online experiment"),
    "Evaluation": ("evaluation", "offline evaluation", "ranking metrics", "precision", "recall"),
    "Fine-tuning": ("fine tuning", "fine-tuning", "lora", "qlora", "peft"),
    "Transformers": ("transformer", "transformers", "hugging face"),
    "PyTorch": ("pytorch",),
    "TensorFlow": ("tensorflow",),
    "Scikit-learn": ("scikit learn", "scikit-learn", "sklearn"),
    "SQL": ("sql",),
    "FastAPI": ("fastapi",),
    "APIs": ("api", "apis", "rest api", "rest APIs"),
    "Backend": ("backend", "back end"),
    "AWS": ("aws", "amazon web services"),
    "Docker": ("docker",),
    "Kubernetes": ("kubernetes", "k8s"),
    "MLOps": ("mlops", "ml ops", "model serving", "model registry"),
    "CI/CD": ("ci/cd", "continuous integration", "continuous deployment"),
    "Data Pipelines": ("data pipeline", "data pipelines", "etl", "airflow", "spark"),
    "Production ML": ("production ml", "production machine learning", "deployed model", "model deployment", "model serving"),
    "Monitoring": ("monitoring", "observability", "model drift", "data drift"),
    "Experimentation": ("experimentation", "experiment design", "experiments"),
}
EXTRA_EVIDENCE = {
    "Deployment": ("deployed", "shipped", "production", "launched", "served"),
    "Scale": ("scale", "scaled", "users", "latency", "throughput"),
    "Metrics": ("metrics", "precision", "recall", "accuracy", "benchmark"),
}
EVALUATION_SKILLS = ("NDCG", "MRR", "MAP", "A/B Testing", "Evaluation", "Experimentation")
PRODUCTION_SKILLS = ("Production ML", "Monitoring", "APIs", "FastAPI", "Backend", "AWS", "Docker", "Kubernetes", "MLOps", "CI/CD", "Data Pipelines")
RETRIEVAL_SKILLS = ("RAG", "Embeddings", "Vector Database", "Retrieval", "Search", "Ranking", "Recommendation Systems", "Information Retrieval")
DEPTH_SKILLS = (
    "Machine Learning", "Deep Learning", "NLP", "LLM", "RAG", "Embeddings", "Fine-tuning",
    "Transformers", "PyTorch", "TensorFlow", "Scikit-learn", "MLOps", "Production ML",
)
CORE_HARD_SKILLS = ("Python", "Embeddings", "Vector Database", "Retrieval", "Ranking", "Evaluation")

TECHNICAL_TERMS = {
    "Python": ("python",),
    "Machine Learning": ("machine learning", "ml"),
    "Artificial Intelligence": ("artificial intelligence", "ai"),
    "LLM": ("llm", "llms", "large language model", "large language models"),
    "RAG": ("rag", "retrieval augmented generation"),
    "Embeddings": ("embedding", "embeddings"),
    "Retrieval": ("retrieval", "search relevance", "semantic search", "vector search"),
    "Ranking": ("ranking", "ranker", "learning to rank", "ltr"),
    "Recommendation Systems": ("recommender", "recommendation system", "recommendation systems"),
    "NLP": ("nlp", "natural language processing"),
    "TensorFlow": ("tensorflow",),
    "PyTorch": ("pytorch",),
    "scikit-learn": ("scikit-learn", "sklearn"),
    "SQL": ("sql",),
    "AWS": ("aws",),
    "GCP": ("gcp", "google cloud"),
    "Azure": ("azure",),
    "Docker": ("docker",),
    "Kubernetes": ("kubernetes", "k8s"),
    "APIs": ("api", "apis", "rest api", "rest apis", "graphql"),
    "Backend": ("backend",),
    "Frontend": ("frontend",),
    "React": ("react", "react.js", "reactjs"),
    "Java": ("java",),
    "C++": ("c++",),
    "Spark": ("spark", "apache spark"),
    "Kafka": ("kafka",),
    "Airflow": ("airflow",),
    "Elasticsearch": ("elasticsearch",),
    "FAISS": ("faiss",),
    "Pinecone": ("pinecone",),
    "Qdrant": ("qdrant",),
    "Milvus": ("milvus",),
    "LangChain": ("langchain",),
}

STATED_EXPERIENCE = (
    r"\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\+?\s*years?\b",
    r"\b(?:at least|min(?:imum)?(?: of)?)\s*(\d{1,2})\+?\s*years?\b",
    r"\b(\d{1,2})\+\s*years?\b",
)
PREFERRED_MARKERS = (
    "preferred", "nice to have", "good to have", "bonus", "would like", "like you to have",
    "won't reject", "will not reject", "desirable", "optional",
)
SENIORITY_KEYWORDS = ("senior", "staff", "lead", "principal", "founding", "architect", "manager")
DOMAIN_KEYWORDS = (
    "ai", "machine learning", "data", "software", "search", "ranking", "recommendation",
    "recruiting", "talent", "hr tech", "marketplace", "fintech", "ecommerce",
)
LOCATIONS = (
    "pune", "noida", "delhi", "gurgaon", "gurugram", "mumbai", "hyderabad", "bangalore",
    "bengaluru", "chennai", "india", "remote", "hybrid", "onsite",
)
ARCHETYPES = {
    "retrieval_ranking_engineer": ("retrieval", "ranking", "recommendation", "ndcg", "mrr", "map"),
    "ai_engineer": ("ai engineer", "llm", "rag", "embeddings"),
    "ml_engineer": ("machine learning", "ml engineer", "mlops", "model deployment"),
    "data_scientist": ("data scientist", "statistics", "analytics"),
    "backend_engineer": ("backend", "api", "distributed systems"),
    "research_scientist": ("research scientist", "papers", "research lab"),
    "product_engineer": ("product engineer", "shipped", "users", "customer"),
}
PRODUCTION_HEAVY = ("production", "deployed", "ship", "users", "api", "backend", "monitoring")
RETRIEVAL_HEAVY = ("retrieval", "ranking", "recommendation", "search", "embeddings")
EVALUATION_HEAVY = ("ndcg", "mrr", "map", "a/b testing", "evaluation")
DISQUALIFIERS = ("pure research", "research only", "consulting only", "demo only")

STOPWORDS = (
    "and", "the", "with", "for", "from", "that", "this", "you", "your", "our",
    "are", "will", "have", "has", "into", "role", "work", "experience", "years",
)

PHRASES = (
    (r"saal\s+ka", "years of"),
    (r"kaam\s+kiya", "worked"),
    (r"maine", "i"),
    (r"banaya|banayi|banaaya", "built"),
    (r"sikha|seekha", "learned"),
    (r"tajurba", "experience"),
    (r"saal", "years"),
    (r"kaam", "work"),
)
NUMBERS = {
    "ek": "1", "do": "2", "teen": "3", "chaar": "4", "paanch": "5",
    "cheh": "6", "saat": "7", "aath": "8", "nau": "9", "das": "10",
}

SENIORITY = (
    "intern", "trainee", "junior", "associate", "engineer", "senior", "lead",
    "staff", "principal", "architect", "manager", "head", "director", "founder",
)
SENIOR_LEVELS = ("senior", "lead", "staff", "principal", "architect", "manager", "head", "director")
CAREER_TERMS = {
    "production": (
        "production", "deployed", "deployment", "scalable", "latency", "monitoring", "api", "backend",
        "cloud", "aws", "docker", "kubernetes", "ci/cd", "users", "live", "rollout", "pipeline",
    ),
    "retrieval": (
        "retrieval", "search", "ranking", "recommender", "recommendation", "vector", "embedding",
        "embeddings", "semantic search", "vector database", "rag", "retriever", "candidate ranking",
        "information retrieval",
    ),
    "evaluation": (
        "ndcg", "mrr", "map", "a/b testing", "experiment", "metrics", "precision", "recall", "f1",
        "offline evaluation", "online evaluation", "benchmark", "evaluation pipeline",
    ),
    "leadership": (
        "led", "owned", "shipped", "designed", "architected", "mentored", "product", "customer",
        "users", "roadmap", "stakeholder",
    ),
    "projects": ("project", "built", "implemented", "developed", "launched", "delivered"),
}
TITLE_PATTERN = (
    r"(?i)\b(?:intern|trainee|junior|associate|senior|lead|staff|principal|architect|manager|head|director|founder)?"
    r"\s*(?:ai|ml|machine learning|data|software|backend|search|ranking|nlp|research)?"
    r"\s*(?:engineer|scientist|architect|manager|developer|researcher)\b"
)
COMPANY_PATTERN = r"\b(?:at|@|with)\s+([A-Z][A-Za-z0-9&.\- ]{1,40}?)(?=\s+(?:as|where|from|for|and)|[,.]|$)"
EXPERIENCE_PATTERN = r"(?i)\b(\d{1,2}(?:\.\d+)?)\+?\s*(?:years?|yrs?)\b"
RANGE_PATTERN = r"(?i)\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\+?\s*years?\b"
SINGLE_PATTERN = r"(?i)\b(\d{1,2}(?:\.\d+)?)\+?\s*years?(?:\s+of\s+experience)?\b"
CALENDAR_PATTERN = r"\b(?:19|20)\d{2}\b"
ZERO_EXPERT_PATTERN = (
    r"(?i)\b(?:expert|advanced|senior)\b.{0,45}\b(?:0|zero)\s*(?:months?|years?)\b"
    r"|\b(?:0|zero)\s*(?:months?|years?)\b.{0,45}\b(?:expert|advanced)\b"
)
ACTIONS = (
    "built", "developed", "deployed", "implemented", "designed", "created", "evaluated",
    "improved", "scaled", "owned", "worked", "experience",
)

RULE_TERMS = {
    "senior": ("senior", "lead", "principal", "staff", "head", "director", "architect"),
    "junior": ("intern", "trainee", "junior", "associate", "fresher"),
    "ai": ("ai", "machine learning", "ml", "nlp", "llm", "rag", "retrieval", "ranking", "recommendation", "data scientist"),
    "non_technical": (
        "marketing", "hr manager", "human resources", "accountant", "sales", "content writer", "graphic designer",
        "operations manager", "customer support", "civil engineer", "mechanical engineer", "data entry",
    ),
    "research": ("research scientist", "researcher", "academic lab", "postdoctoral", "postdoc"),
    "production": ("production", "deployed", "shipped", "api", "monitoring", "latency", "scale", "users", "docker", "kubernetes", "aws"),
    "retrieval_claims": ("rag", "retrieval", "ranking", "search", "recommendation systems", "embeddings", "vector database"),
    "evaluation_claims": ("ndcg", "mrr", "map", "a/b testing", "evaluation", "experimentation"),
    "production_claims": ("production ml", "mlops", "monitoring", "docker", "kubernetes", "aws", "apis"),
}

FIELD_ALIASES = {
    "candidate_id": ("candidate_id", "candidateid", "profile_id", "user_id", "id"),
    "summary": ("summary", "profile_summary", "about", "bio", "description"),
    "headline": ("headline", "profile_headline", "professional_headline"),
    "current_title": ("current_title", "current_role", "job_title", "designation", "title"),
    "years_of_experience": ("years_of_experience", "experience_years", "total_experience", "years_experience"),
    "location": ("location", "current_location", "city", "address"),
    "skills": ("skills", "skill_set", "technical_skills", "competencies"),
    "career_history": ("career_history", "work_experience", "experience_history", "employment_history", "work_history"),
    "projects": ("projects", "project_history", "portfolio", "achievements"),
    "education": ("education", "education_history", "qualifications"),
}
SCALAR_FIELDS = ("candidate_id", "summary", "headline", "current_title", "years_of_experience", "location")
BEHAVIOR_FIELDS = (
    "recruiter_response_rate", "response_rate", "avg_response_time_hours", "last_active_date", "last_activity",
    "profile_views_received_30d", "profile_views", "saved_by_recruiters_30d", "saved_by_recruiters",
    "interview_completion_rate", "applications_submitted_30d", "skill_assessment_scores", "assessment_scores",
    "endorsements_received",
)
AVAILABILITY_FIELDS = (
    "notice_period_days", "notice_period", "notice_days", "willing_to_relocate", "relocation", "open_to_work_flag",
    "open_to_work", "available_for_work", "preferred_work_mode", "work_mode", "employment_status",
)

SCORE_WEIGHTS = {
    "jd_relevance": 0.25, "must_have_skill": 0.20, "proof_alignment": 0.25,
    "retrieval_evaluation_depth": 0.10, "production_readiness": 0.10, "hireability": 0.10,
}
PROFILE_PENALTIES = {"empty_profile_text": 0.15, "extremely_high_keyword_density": 0.10, "missing_skills": 0.05, "missing_experience": 0.05}
RULE_PENALTIES = {
    "zero_duration_expert_claim": 0.25, "expert_claim_without_tenure": 0.20, "excessive_keyword_density": 0.15,
    "buzzword_stuffing": 0.15, "many_claimed_skills_weak_evidence": 0.18, "unsupported_required_skill": 0.20,
    "weak_proof_alignment": 0.15, "seniority_evidence_mismatch": 0.15, "title_skill_mismatch": 0.12,
    "research_only_for_production_jd": 0.08, "missing_availability_signals": 0.03, "empty_profile_text": 0.50,
}
CALIBRATION_WEIGHTS = {"evidence_confidence": 0.30, "career_depth": 0.15, "jd_constraint_match": 0.25, "hireability": 0.10, "top10_readiness": 0.20}
