"""Literal relations of the data model."""

from __future__ import annotations

# Traits of each disease category, in order of precedence.
TRAIT_CATEGORIES = {
    'Neurological Disorders': [
        'Schizophrenia',
        'Restless legs syndrome',
        'Multiple sclerosis',
        "Parkinson's disease",
        "Alzheimer's disease",
        "Alzheimer's disease (late onset)",
        "Alzheimer's disease in APOE e4- carriers",
        'Generalized epilepsy',
        'Essential tremor',
        'Myopia (pathological)',
        'Idiopathic inflammatory myopathy',
        'Bipolar disorder',
        'Neuromyelitis optica',
        'Neuromyelitis optica (AQP4-IgG-positive)',
        'Creutzfeldt-Jakob disease (sporadic)',
        'Major depressive disorder',
        'Frontotemporal dementia',
        'Frontotemporal dementia with GRN mutation',
        "Alzheimer's disease (APOE e4 interaction)",
        'Cluster headache',
        'Decreased low contrast letter acuity in multiple sclerosis',
        'Hippocampal sclerosis of aging',
        'Oligoclonal band status in multiple sclerosis',
        'Opioid dependence',
        "Parkinson's disease (familial, age at onset)",
    ],
    'Autoimmune and Inflammatory Diseases': [
        'Ulcerative colitis',
        'Psoriasis',
        "Sjögren's syndrome",
        'Rheumatoid arthritis',
        'Systemic lupus erythematosus',
        "Behcet's disease",
        'Takayasu arteritis',
        'Atopic march',
        'Dermatomyositis or juvenile dermatomyositis',
        'Polymyositis',
        'Vitiligo (early onset)',
        'Vitiligo (late onset)',
        'Primary biliary cholangitis',
        'Primary sclerosing cholangitis',
        'Allergic rhinitis',
        'Childhood steroid-sensitive nephrotic syndrome',
        'Adult asthma',
        "Adult onset Still's disease",
        'Allergic disease (asthma, hay fever or eczema)',
        'Arthritis (juvenile idiopathic)',
        'Asthma',
        'Birdshot chorioretinopathy',
        "Crohn's disease",
        'Eczema',
        'Hydrolysed wheat protein allergy',
        'Membranous nephropathy',
        'Peanut allergy',
        'Periodontitis',
        "Poor prognosis in Crohn's disease",
        'Refractory celiac disease type II',
        'Rheumatoid arthritis (rheumatoid factor and/or anti-cyclic citrullinated peptide seropositive)',
        "Thyroid-associated orbitopathy in graves' disease",
        'Vogt-Koyanagi-Harada syndrome',
    ],
    'Cancer': [
        'Bladder cancer',
        'Breast cancer',
        'Esophageal cancer',
        'Prostate cancer',
        'Lung cancer',
        'Colorectal cancer',
        'Diffuse large B cell lymphoma',
        "Hodgkin's lymphoma",
        'Pancreatic cancer',
        'Gallbladder cancer',
        'Non-small cell lung cancer (survival)',
        'Breast Cancer in BRCA1 mutation carriers',
        'Breast cancer (estrogen-receptor negative, progesterone-receptor negative, and human epidermal growth factor-receptor negative)',
        'Endometrial endometrioid carcinoma',
        'Non-melanoma skin cancer',
        'B-cell acute lymphoblastic leukaemia (ETV6-RUNX1 positive)',
        'B-cell acute lymphoblastic leukaemia (high-hyperdiploidy)',
        'Neuroblastoma or malignant cutaneous melanoma',
        'Colon cancer',
        'Metastasis at diagnosis in osteosarcoma',
        'B-cell acute lymphoblastic leukaemia',
        'Breast cancer (estrogen-receptor negative)',
        'Cardia gastric cancer',
        'Chronic lymphocytic leukemia',
        'EGFR mutation-positive lung adenocarcinoma',
        'Endometrial cancer',
        'Gastric cancer',
        'Lung adenocarcinoma',
        'Melanoma',
        'Meningioma',
        'Multiple myeloma',
        'Myeloproliferative neoplasms',
        'Nodular sclerosis Hodgkin lymphoma',
        'Non-cardia gastric cancer',
        'Prostate cancer (survival)',
        'Survival in colorectal cancer (distant metastatic)',
        'Survival in colorectal cancer (non-distant metastatic)',
        'Urinary bladder cancer',
        'Uterine fibroids',
    ],
    'Metabolic Disorders': [
        'Type 1 diabetes',
        'Type 2 diabetes',
        'Metabolic syndrome',
        'Polycystic ovary syndrome',
        'Obesity (early onset extreme)',
        'Gout',
        'Gout vs. Hyperuricemia',
        'Hyperuricemia',
        'Proliferative diabetic retinopathy',
        'Diabetes in response to antihypertensive drug treatment (treatment strategy interaction)',
        'Renal overload gout',
        'Renal underexcretion gout',
    ],
    'CVD and Chronic Conditions': [
        'Renal function and chronic kidney disease',
        'Chronic obstructive pulmonary disease',
        'Chronic obstructive pulmonary disease (moderate to severe)',
        'Chronic obstructive pulmonary disease (severe)',
        'Coronary artery disease',
        'Coronary artery disease in type 1 diabetes',
        'Hypertension',
        'Abdominal aortic aneurysm',
        'Venous thromboembolism',
        'Venous thromboembolism adjusted for sickle cell variant rs77121243-T',
        'Aortic valve stenosis',
        'Retinal detachment or retinal break',
        'Acute-on-chronic liver failure in hepatitis B',
        'Atrial fibrillation',
        'Bicuspid aortic valve without aortic dilation',
        'Brugada syndrome',
        'Chronic kidney disease (chronic kidney disease vs normal or mildly reduced eGFR) in type 1 diabetes',
        'Chronic kidney disease (severe chronic kidney disease vs normal kidney function) in type 1 diabetes',
        'Chronic venous disease',
        'Coronary heart disease',
        'Idiopathic pulmonary fibrosis',
        'Intracerebral hemorrhage',
        'Ischemic stroke',
        'Kidney disease (early and late stages) in type 1 diabetes',
        'Kidney disease (early stage) in type 1 diabetes',
        'Kidney disease (end stage renal disease vs non-end stage renal disease) in type 1 diabetes',
        'Kidney disease (end stage renal disease vs normoalbuminuria) in type 1 diabetes',
        'Kidney disease (late stage) in type 1 diabetes',
        'Peripheral artery disease',
        'Resistance to antihypertensive treatment in hypertension',
        'Small vessel stroke',
    ],
    'Infectious Diseases': [
        'Acute respiratory distress syndrome in sepsis',
        'Tuberculosis',
        'Chronic hepatitis B infection',
        'Chronic hepatitis C infection',
        'Hepatitis B',
        'Hepatocellular carcinoma in post hepatitis C eradication by interferon therapy',
        'Liver injury in anti-retroviral drug treated HIV',
        'Liver injury in anti-tuberculosis drug treatment',
        'Liver injury in combined anti-retroviral and anti-tuberculosis drug-treated HIV with tuberculosis',
        'Leishmaniasis (visceral)',
        'Buruli ulcer',
        'Buruli ulcer (age at onset)',
        'Recurrence of mild malaria attacks',
        'Recurrence of malaria infection (mild or asymptomatic)',
        'Acute-on-chronic liver failure in hepatitis B',
    ],
    'Developmental and Structural Conditions': [
        'Achilles tendinopathy',
        'Anterior cruciate ligament rupture',
        'Sagittal craniosynostosis',
        'Temporomandibular joint disorder',
        'Osteoarthritis',
        'Osteoarthritis (hand, severe)',
        'Myopia (pathological)',
        'Adolescent idiopathic scoliosis',
    ],
    'Other Conditions': [
        'Alcohol consumption (heavy vs. light/non-drinkers)',
        'Acne (severe)',
        'End-stage renal disease in Type 1 diabetics',
        'Longevity (85 years and older)',
        'Longevity (90 years and older)',
        'Longevity (age >90th survival percentile)',
        'Longevity (age >99th survival percentile)',
        'Pre-treatment pain in head and neck squamous cell carcinoma',
        'Response to platinum-based neoadjuvant chemotherapy in cervical cancer',
        'Tooth agenesis',
        'Tooth agenesis (mandibular second premolars)',
        'Tooth agenesis (maxillary lateral incisors)',
        'Sasang constitutional medicine type (So-Eum)',
        'Birdshot chorioretinopathy',
        'Bortezomib-induced peripheral neuropathy in multiple myeloma',
        'Chronic central serous retinopathy',
        'Early spontaneous preterm birth',
        'Exfoliation glaucoma or exfoliation syndrome',
        'Gallstone disease',
        'Gene methylation in lung tissue',
        'Glaucoma (primary open-angle)',
        'Irritable bowel syndrome',
        'Macular telangiectasia type 2',
        'Post-term birth',
        'Response to Pazopanib in cancer (hepatotoxicity)',
        'Trastuzumab-induced cardiotoxicity in cancer',
        'Uterine fibroids',
    ],
}

# Traits that overviews leave out.
BLOCKED_TRAITS = [
    'Liver injury in combined anti-retroviral and anti-tuberculosis drug-treated HIV with tuberculosis',
    'Pre-treatment pain in head and neck squamous cell carcinoma',
    'Recurrence of mild malaria attacks',
    'Recurrence of malaria infection (mild or asymptomatic)',
    'Kidney disease (late stage) in type 1 diabetes',
    'Renal function and chronic kidney disease',
    'Chronic kidney disease (severe chronic kidney disease vs normal kidney function) in type 1 diabetes',
    'Acute-on-chronic liver failure in hepatitis B',
    'Decreased low contrast letter acuity in multiple sclerosis',
    'Straight vs curly hair',
    'Decreased fine motor function in Charcot-Marie-Tooth disease 1A (eating with utensils)',
    'Impaired insulin sensitivity in response to n-3 PUFA supplementation',
    'Hepatitis B surface antigen seroclearance in chronic hepatitis B infection',
    'Allergic sensitization',
    'Breast cancer in childhood cancer survivors treated with more than 10 gray radiotherapy',
    'Morning vs. evening chronotype',
    'Myocardial infarction in darapladib-treated cardiovascular disease (time to event)',
    'Lung function in never smokers (high FEV1 vs average FEV1)',
    'Lung function in never smokers (low FEV1 vs high FEV1)',
    'Angioedema in response to angiotensin-converting enzyme inhibitor and/or angiotensin receptor blocker',
    'Alzheimer’s disease and/or vascular dementia (clinical subgroup VaD+)',
    'Low HDL-cholesterol levels',
    'High fasting blood glucose',
    'Thick vs thin eyebrows',
    'Decreased sensory function in Charcot-Marie-Tooth disease type 1A',
    'Hearing loss in Charcot-Marie-Tooth disease 1A',
]

# Traits of the blood pressure panel.
BLOOD_PRESSURE_TRAITS = [
    'Diastolic blood pressure',
    'Mean arterial pressure',
    'Pulse pressure',
    'Response to beta blocker use in hypertension (systolic blood pressure)',
    'Systolic blood pressure',
    'Systolic blood pressure (dietary potassium intake interaction)',
]

# Traits of the lipid panel.
LIPID_TRAITS = [
    'HDL cholesterol',
    'HDL cholesterol levels',
    'High density lipoprotein cholesterol levels',
    'LDL cholesterol',
    'LDL cholesterol levels',
    'Low density lipoprotein cholesterol levels',
    'Response to fenofibrate (LDL cholesterol levels)',
    'Response to fenofibrate (triglyceride levels)',
    'Triglyceride levels',
    'Triglycerides',
]

# Labels of the lipid panel. The last one merges two responses under one label, as views expect.
LIPID_LABELS = {
    'LDL cholesterol levels': 'LDL cholesterol',
    'LDL cholesterol': 'LDL cholesterol',
    'Low density lipoprotein cholesterol levels': 'LDL cholesterol',
    'Triglyceride levels': 'Triglycerides',
    'Triglycerides': 'Triglycerides',
    'HDL cholesterol levels': 'HDL cholesterol',
    'HDL cholesterol': 'HDL cholesterol',
    'High density lipoprotein cholesterol levels': 'HDL cholesterol',
    'Response to fenofibrate (LDL cholesterol levels)': 'Response to fenofibrate (LDL cholesterol levels)',
    'Response to fenofibrate (triglyceride levels)': 'Response to fenofibrate (LDL cholesterol levels)',
}

# Traits of the panel of other blood markers.
OTHER_MARKER_TRAITS = [
    'Asymmetrical dimethylarginine levels',
    'Bilirubin levels',
    'Creatine kinase levels in statin users',
    'Creatinine clearance',
    'Estimated glomerular filtration rate',
    'Gamma glutamyl transferase levels',
    'Glycated hemoglobin levels',
    'Hematocrit',
    'Hemoglobin levels',
    'Hepcidin levels',
    'kallikrein-11 levels',
    'L-arginine levels',
    'Mean corpuscular hemoglobin',
    'Platelet count',
    'Plasma free asparagine levels',
    'Plasma free proline levels',
    'Plasma plasminogen activator levels',
    'Plasma thyroid-stimulating hormone levels',
    'Red blood cell count',
    'Resistin levels',
    'Serum alkaline phosphatase levels',
    'Serum creatinine levels',
    'Serum galactose-deficient IgA1 levels',
    'Serum IgE levels',
    'Serum parathyroid hormone levels',
    'Serum uric acid levels',
    'Symmetrical dimethylarginine levels',
    'Thyroid stimulating hormone levels',
    'Uric acid clearance',
    'White blood cell count',
]

# Columns of the sports table.
SPORTS_COLUMNS = [
    'SNP',
    'chr_name',
    'Beta',
    'effect_allele',
    'non_effect_allele',
    'ensembl_alleles',
    'Comment',
    'power_allele',
    'endurance_allele',
    'gene',
]

# Rows of the sports table.
SPORTS_SNPS = [
    ('rs1815739', '11', None, 'T', 'C', 'C/T', 'This C variant of this SNP breaks the ACTN3. The T variant have been found to be associated with better sprint performance (PMID 12879365)', 'T', None, 'ACTN3'),
    ('rs4646994', '17', None, None, None, 'I/D', "ACE - this variant is found in one study to potentially distinguish between capability in power-sports vs endurance-sports (PMID 25943990). However it is also mentioned in several studies of other traits such as hypertension and alzheimers. The evidence behind it's effect remain unclear. Insertations (I) are the ones supposed to be associated with endurance, and deletions (D) with power-sports.", 'D', 'I', 'ACE'),
    ('rs699', '1', None, 'C', 'T', 'C/T', 'AGT - the C allele of this SNP has been found to associate with ability in power-sports (PMID 20029521)', 'C', None, 'AGT'),
    ('rs1800012', '17', None, None, None, 'G/T', 'COL1A1 - the T allele was found to be associated with protection against injuries (acute soft tissue ruptures.). PMID 19193665.', 'T', 'T', 'COL1A1'),
]

# Well-known variants: rsid, description, effect allele.
POPULAR_SNPS = [
    ("rs333", "HIV resistance (CCR5)", "-"),
    ("rs1815739", "Sprint performance (ACTN3)", "C"),
    ("rs12913832", "Blue eyes", "G"),
    ("rs1042522", "Cancer risk modulation (TP53)", "C"),
    ("rs53576", "Empathy and social behavior (OXTR)", "A"),
    ("rs1805007", "Red hair color", "T"),
    ("rs1805008", "Red hair color", "T"),
    ("rs7221412", "Nightowl chronotype", "G"),
]
#: A vendor's own id, and the rsid that it stands for.
VENDOR_RSIDS = {"i3003626": "rs333"}

# Example sports scores.
SPORT_SCORES = [("Running", 85), ("Swimming", 92), ("Power Lifting", 78), ("Sprinting", 88), ("Endurance", 95)]

# The two constants of the power and endurance view.
POWER_ENDURANCE = [("Power", 75), ("Endurance", 50)]

# Corners (latitude, longitude) of the region of each superpopulation.
SUPERPOPULATIONS = {
    "European": [(71.0, -10.0), (71.0, 40.0), (36.0, 40.0), (36.0, -10.0), (71.0, -10.0)],
    "East Asian": [(55.0, 100.0), (55.0, 140.0), (10.0, 140.0), (10.0, 100.0), (55.0, 100.0)],
    "African": [(37.0, -17.0), (37.0, 51.0), (-35.0, 51.0), (-35.0, -17.0), (37.0, -17.0)],
    "South Asian": [(35.0, 60.0), (35.0, 90.0), (5.0, 90.0), (5.0, 60.0), (35.0, 60.0)],
    "Admixed American": [(48.0, -125.0), (48.0, -30.0), (-55.0, -30.0), (-55.0, -125.0), (48.0, -125.0)],
}

# Colours of categories, and of the nodes above them.
CATEGORY_COLOURS = {
    "Autoimmune and Inflammatory Diseases": "#4CAF50",
    "Cancer": "#F44336",
    "CVD and Chronic Conditions": "#2196F3",
    "Infectious Diseases": "#FF9800",
    "Metabolic Disorders": "#9C27B0",
    "Neurological Disorders": "#3F51B5",
    "Other Conditions": "#607D8B",
    "Developmental and Structural Conditions": "#00BCD4",
}
NODE_COLOURS = {"Predisposition": "#D55E00", "Protective": "#009E73", "SNPs": "#EEEEEE"}
DEFAULT_COLOUR = "#000000"
